"""Whole jobs against brute force: near-copies of the pipeline, repeated rows, repeated items, scarce texts."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import language, near_copies, pages, queries, substrings

DOCS = "doc_id bigint, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_of(rows):
    """Ids that stay: the smallest of every component of pairs with similarity 0.8 or more."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), n), n)
    return sorted(least.values())


def edited(rng, text, similarity):
    """A copy with words changed until its similarity is just above (or, by one more change, below) the bound."""
    w, base, last = text.split(), shingles(text), text
    while True:
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        s = shingles(" ".join(w))
        if len(s & base) / len(s | base) < similarity:
            return last, " ".join(w)
        last = " ".join(w)


def planted(sources, seed=4):
    rng = random.Random(seed)
    copies = [c for t in sources for s in (0.8, 0.9, 0.95) for c in edited(rng, t, s)]
    group = [edited(rng, sources[0], 0.97)[0] for _ in range(30)]
    common = [f"{' '.join(sources[1].split()[:40])} {' '.join(f'r{rng.randrange(10**6)}' for _ in range(rng.randrange(8, 60)))}" for _ in range(40)]
    return copies + group + common


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    rng = random.Random(1)
    sources = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(90, 400))) for _ in range(8)]
    texts = sources + planted(sources) + [None, "", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = near_copies.one_of_each(spark.createDataFrame(rows, DOCS + "").repartition(3))
    assert out.columns == ["doc_id", "text"] and sorted(r.doc_id for r in out.collect()) == kept_of(rows)
    assert len(kept_of(rows)) < len(rows) - 40


def test_near_copies_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (5, text + " y"), (5, text + " y"), (None, "else"), (None, "else")]
    assert sorted(map(str, (r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, DOCS)).collect()))) == ["5", "None"]
    assert near_copies.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def documents_with_copies(spark, path, extra=()):
    """Documents of the tables with planted copies, and their benchmark, below ``path``."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = [r for r in docs.orderBy("doc_id").limit(120).collect() if len((r.text or "").split()) > 90]
    copies = [r.asDict() | {"doc_id": 10**9 + i * 100 + j, "text": t} for i, r in enumerate(long[:5]) for j, t in enumerate(planted([r.text, r.text], i)[:6])]
    frame = spark.createDataFrame([r.asDict() for r in long] + copies + [long[0].asDict() | e for e in extra], docs.schema)
    frame = frame.withColumn("row", F.lit(1)).withColumn("node", F.lit("x"))
    frame.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return frame


def test_pipeline(spark, tmp_path):
    """Every stage keeps what brute force keeps of its input; then run() gives the tokens of what the last but one keeps."""
    path = str(tmp_path)
    docs = documents_with_copies(spark, path, [{"doc_id": None}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": ""}, {"doc_id": 5, "source": None, "lang": None}])
    benchmark = spark.read.parquet(f"{path}/benchmark.parquet").collect()
    learned = language.learn(docs)
    want = {r.doc_id for r in language.accepted(docs, learned).collect()}
    told = corpus_pipeline.told_language(spark, docs, path)
    assert told.columns == docs.columns and {r.doc_id for r in told.collect()} == want
    rows = [tuple(r) for r in told.select("doc_id", "text").where("doc_id is not null").collect()]
    single = corpus_pipeline.one_of_near_copies(spark, told.where("doc_id is not null"), path)
    kept = [r.doc_id for r in single.collect()]
    assert sorted(kept) == sorted(kept_of(rows)) and len(kept) < len(rows)
    items = [(lambda s: (s, -(-4 * len(s) // 5)))(shingles(r.text)) for r in benchmark]
    clean = [r.doc_id for r in single.collect() if not any(i and len(i & shingles(r.text)) >= least for i, least in items)]
    assert sorted(r.doc_id for r in corpus_pipeline.without_benchmark(spark, single, path).collect()) == sorted(clean)
    out = corpus_pipeline.run(spark, path).collect()
    taken = {r.doc_id for r in out}
    assert taken and taken <= set(clean) | {None} and sum(r.n_tokens for r in out) == sum(len(r.ids) for r in out) and all(r.ids[-1] == 0 for r in out)


def test_pipeline_without_rows(spark, tmp_path):
    documents_with_copies(spark, f"{tmp_path}/full").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_stay_once(spark):
    """Rows of equal id and text are one document: its first copy of a passage stays."""
    rng = random.Random(2)
    passage, *other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 150, 150, 150))
    texts = {1: other[0] + passage, 2: passage + other[1], 3: other[2] + passage[:300]}
    rows = [(1, texts[1])] * 3 + [(2, texts[2])] * 2 + [(3, texts[3])]
    seen, want = set(), {}
    for n, text in texts.items():
        gone = set()
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(text[i : i + 100])
        want[n] = "".join(c for i, c in enumerate(text) if i not in gone).encode()
    got = substrings.without_later_copies(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows) and all(bytes(r.kept) == want[r.doc_id] for r in got) and want[1] == texts[1].encode()


def test_every_repeated_item(spark, tmp_path):
    items = [(1, "the quick brown fox jumps over it"), (2, "THE quick  brown fox jumps over it"), (3, " the quick brown fox jumps over it"), (3, "the quick brown fox jumps over it"), (None, "the quick brown fox jumps over it"), (4, "not in any of them at all")]
    docs = [(7, "so the quick brown fox jumps over it again"), (8, "nothing here"), (9, "The quick brown fox jumps over it")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op2_decontaminate(spark, str(tmp_path)).collect()]
    assert len(got) == 8 and set(got) == {(d, i, 3, 3, 1.0) for d in (7, 9) for i in (1, 2, 3, None)}


def test_scarce_texts_are_learned(spark):
    """The sample counts usable rows only, and rows of one id are not one draw."""
    empty = [(i, None if i % 2 else "12 ?!", "xx") for i in range(40000)]
    scarce = [(10**6 + i, f"lo mi ra {i} zz", "xx") for i in range(40)]
    without_id = [(None, f"ta bu {i} ne", "yy") for i in range(3000)]
    repeated = [(None, "qo qe", "zz")] * 3000 + [(None, "... " * 800 + "wo", "vv")]
    docs = spark.createDataFrame(empty + scarce + without_id + repeated, "doc_id bigint, text string, lang string").repartition(4)
    got = language.learn(docs)
    assert sorted(got) == ["vv", "xx", "yy", "zz"]
    usable = docs.where(~language.held_out() & (docs.lang == "xx") & docs.text.rlike("[a-z]")).count()
    assert got["xx"].count(b"lo") == usable > 20 and got["yy"].count(b"ta") == language.SAMPLE_DOCS and got["zz"].count(b"qo") == 1


def test_names_inside_an_article():
    """Slugs, inline names and title headers inside an article stay; comments go, as articles too."""
    html = (
        '<article><header class="entry-header"><h1>Title</h1></header><div class="post-header"><p>By A</p></div><h2 id="related-work">Related work</h2>'
        '<section id="search-methods"><p>We <a class="related">searched</a> far</p></section><h2 id="social-effects">Effects</h2>'
        '<div class="comments-area"><p>no</p></div><div id="comments">no</div><div class="ad">no</div><ul class="social-share"><li>no</ul><article class="comment">no</article></article>'
        '<article class="comment">no</article><article class="post has-comments"><p>yes</p></article>'
    )
    assert [text for _, _, text, _ in pages.blocks(html)] == ["Title", "By A", "Related work", "We searched far", "Effects", "yes"]


def test_style_tree_weighs_every_page(spark):
    """A notice that no name tells goes from articles, and a body beside teasers stays."""
    notice = "Get our letter each week"
    rows = [(i, "http://a.example/x", f"<article><h1>Title {i}</h1><p>Body {i} of a page</p><p>{notice}</p><p>{'Now and then' if i % 2 else 'Rare'}</p></article>") for i in range(12)]
    rows += [(20 + i, "http://b.example/x", f"<div><p>The long body of page {i}, which tells it all</p></div><article class='card'><p>Story</p></article>") for i in range(4)]
    rows += [(30 + i, "http://c.example/x", f"<article><p>{notice}</p><p>Few pages {i}</p></article>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nBody {i} of a page\n{'Now and then' if i % 2 else 'Rare'}"
    for i in range(4):
        assert got[20 + i] == f"The long body of page {i}, which tells it all"
        assert got[30 + i] == f"{notice}\nFew pages {i}"
