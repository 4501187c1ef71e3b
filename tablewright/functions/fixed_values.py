"""Word lists, patterns and report texts that decide results.

Everything here is data.  The lists are English and Indonesian and can be
extended through the configuration; they are kept in one place so that the
operators never carry words of their own.
"""

# ---------------------------------------------------------------- fixed values
# Column names that announce a date.
DATE_NAMES = (
    "tanggal", "date", "tgl", "waktu", "time",
    "created", "updated", "modified", "timestamp",
    "lahir", "birth", "expired", "deadline",
    "mulai", "selesai", "start", "end",
)

# Date formats tried one by one when the general rules read less than half.
DATE_FORMATS = (
    "%Y-%m-%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%d-%m-%Y",
    "%d %B %Y",
    "%d %b %Y",
    "%Y/%m/%d",
    "%d.%m.%Y",
    "%B %d, %Y",
    "%b %d, %Y",
    "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y %H:%M",
)

# Text that looks like a date anywhere inside a value.
DATE_CONTENT_PATTERNS = (
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{4}",
    r"\d{1,2}\s+\w+\s+\d{4}",
    r"\d{1,2}\.\d{1,2}\.\d{4}",
)

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Column names of phone numbers and identifiers: digits there stay text.
IDENTIFIER_NAMES = (
    "telp", "telepon", "phone", "hp", "id",
    "nik", "nip", "kode", "code", "no_", "nomor",
)

# Column names that are never a person, place or title.
NOT_A_NAME = (
    "deskripsi", "description", "desc", "keterangan", "notes", "catatan",
    "detail", "komentar", "comment", "review", "ulasan", "text", "teks",
    "lirik", "lyrics", "alamat", "address", "url", "uri", "link", "email",
    "e-mail", "kode", "code", "id", "uuid", "sku", "slug", "status",
    "query", "search", "log", "message", "pesan", "tanggal", "date",
    "waktu", "time", "harga", "price", "gaji", "salary", "nominal", "total",
)

# Column names that hold a person, place or title.
NAME_WORDS = (
    "nama", "name", "artist", "artis", "musician", "singer", "penyanyi", "band",
    "tour", "tour_title", "tour_name", "konser", "concert", "title", "judul",
    "song", "lagu", "album", "track", "kota", "city", "negara", "country",
    "provinsi", "province", "venue", "lokasi", "location", "tempat",
    "customer", "pelanggan", "client", "klien", "author", "penulis", "penerbit",
    "pembeli", "buyer", "seller", "penjual", "user", "pengguna", "member", "anggota",
)

# Words always written in capitals.
ACRONYMS = (
    "USA", "UK", "UAE", "EU", "UN", "WHO", "UNESCO", "NYC", "LA", "DC",
    "JKT", "BDG", "SBY", "YGY", "JOGJA", "IDR", "USD", "EUR", "GBP", "SGD", "AUD",
    "WIB", "WITA", "WIT", "PT", "CV", "TBK", "BUMN", "BUMD", "DPR", "MPR", "KPK",
    "KTP", "SIM", "KK", "NPWP", "PPN", "PPH", "BPJS", "BMKG", "RSUD", "RS",
    "VIP", "VVIP", "DJ", "MC", "OST", "MV", "EP", "LP", "CD", "DVD", "HQ", "HD",
    "BTS", "NCT", "EXO", "TXT", "SEVENTEEN", "BLACKPINK", "AKB48", "JKT48",
    "EDM", "R&B", "TV", "FM", "AM",
    "CEO", "CFO", "CTO", "COO", "CMO", "HR", "IT", "PR", "AI", "ML", "API",
    "URL", "URI", "SQL", "HTML", "CSS", "JS", "FAQ", "SKU", "ID", "PO", "SPK",
    "II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "XII", "XIII", "XIV", "XV",
    "XVI", "XVII", "XVIII", "XIX", "XX",
)

# What follows an apostrophe and stays in lower case.
SMALL_APOSTROPHE_PARTS = ("s", "t", "d", "m", "ll", "re", "ve")

# Column names that decide how a number is shown.
MONEY_NAMES = (
    "gaji", "salary", "harga", "price", "biaya", "cost", "total", "subtotal",
    "nominal", "amount", "revenue", "untung", "laba", "rugi",
)
PERCENT_NAMES = ("persen", "percent", "pct", "diskon", "discount", "pajak_pct", "margin")
DATE_MASK_NAMES = ("tanggal", "date", "tgl", "lahir", "birth", "created", "expired")
INTEGER_NAMES = (
    "umur", "age", "qty", "quantity", "jumlah", "stok", "stock", "count", "tahun", "year",
)

# Display masks by role.
MASKS = {
    "currency_idr": '"Rp" #,##0',
    "currency_idr_dec": '"Rp" #,##0.00',
    "currency_usd": '"$"#,##0.00',
    "currency_eur": "€#,##0.00",
    "integer": "#,##0",
    "decimal": "#,##0.00",
    "decimal_3": "#,##0.000",
    "percent": "0.0%",
    "percent_2": "0.00%",
    "date_iso": "yyyy-mm-dd",
    "date_id": "dd/mm/yyyy",
    "date_medium": "dd-mmm-yyyy",
    "datetime": "yyyy-mm-dd hh:mm:ss",
    "text": "@",
}

# Columns a TOTAL row leaves out.
NOT_IN_TOTAL = ("umur", "age", "id", "nik", "nip", "tahun", "year", "kode")

# Currency marks removed before a number is read.
CURRENCY_MARKS = r"(Rp\.?|IDR|USD|\$|€|£|¥)"
# Currency marks that may stand around a number when two values are compared.
COMPARE_CURRENCIES = r"(?:rp|idr|usd|eur|gbp|jpy|cny|inr|[$€£¥₹])"
# Footnote marks that may follow a number when two values are compared.
COMPARE_FOOTNOTES = r"(?:\[\d+\]|\(\d+\)|[*†‡¹²³⁴⁵⁶⁷⁸⁹⁰])+$"
# Whole values that are compared as dates.
COMPARE_DATE = (
    r"^(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
    r"|\d{1,2}\s+[A-Za-z]+\s+\d{4}"
    r"|[A-Za-z]+\s+\d{1,2},?\s+\d{4})$"
)

# Cells that a CSV or workbook reader takes as empty (public pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Words read as null by the number rules.
NUMBER_NULLS = ("nan", "None", "")

# Windows-1252 characters of the bytes 0x80 to 0x9F, in byte order; the five
# undefined bytes are left out on both sides.
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"

# Names and texts of the combined outputs.
SOURCE_COLUMN = "Sumber File"
STAGE_COLUMN = "Tahap"
ORIGIN_COLUMN = "File Asal"
REASON_COLUMN = "Alasan"
REASON_IN_BASE = "sudah ada di file dasar"
REASON_IN_FILE = "duplikat di file baru"
REASON_ORPHAN = "{key} {value} tidak ditemukan di {left}"
EMPTY_KEY = "<kosong>"
JOINED_NAME = "hasil gabungan"
TOTAL_LABEL = "TOTAL"
TEXT_DEFAULT = "Unknown"
ALREADY_CLEAN = "Data already clean"
AMBIGUOUS_WARNING = (
    "'{column}': {n} tanggal ambigu (hari/bulan sama-sama ≤12, "
    "tidak ada bukti urutan) — diasumsikan DD/MM/YYYY, mohon dicek"
)
# ------------------------------------------------------------ end fixed values
