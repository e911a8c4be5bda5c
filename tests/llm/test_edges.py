"""Nulls, empty texts and tables, repeated rows, clashing column names."""

import pytest

from graphloom.llm.decontam import drop_contaminated, find_hits, remove_spans
from graphloom.llm.embed_dedup import near_dups
from graphloom.llm.jaccard_join import near_classes
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.quality import N_FEATURES, Forest, fit_forest, score_quality
from graphloom.llm.scan import Scratch
from graphloom.llm.substring_dedup import remove_passages, repeated_passages

import numpy as np

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ROWS = [(1, None, 7), (2, "", 7), (3, f"x {WORDS} y", 7), (3, f"x {WORDS} y", 7), (4, "clean text here", 7), (None, "a b", 7)]
SCHEMA = "doc_id long, text string, N_Words int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, WORDS.upper()), (2, None), (3, "")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in find_hits(docs, bench).collect()) == [(0, 2, 0), (1, 0, 0), (2, 0, 0), (3, 15, 13), (3, 15, 13), (4, 3, 0)]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 4
    assert {r.text for r in remove_spans(docs, bench).where("doc_id = 3").collect()} == {"x  y"}
    assert find_hits(none, bench).count() == 0
    assert find_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize(("share", "left"), [(0.05, 4), (0.3, 4), (0.86, 4), (0.87, 6), (0.9, 6)])
def test_decontamination_share(spark, docs, share, left):
    """13 of the 15 words are hit: 0.8666..."""
    bench = spark.createDataFrame([(1, WORDS)], "item_id long, text string")
    assert drop_contaminated(docs, bench, share).count() == left


def test_decontamination_in_blocks(spark, docs):
    bench = spark.createDataFrame([(1, WORDS), (2, WORDS + " xi")], "item_id long, text string")
    pick = lambda df: sorted((r.doc_id or 0, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())
    assert pick(find_hits(docs, bench, max_bytes=100)) == pick(find_hits(docs, bench))


def test_line_dedup(spark, docs, none):
    assert dedup_lines(docs).count() == len(ROWS) and dedup_lines(none).count() == 0
    two = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(two).collect()} == {1: "a\nb\nc\nd", 2: "x\ny"}


def test_line_dedup_rows_that_share_an_id(spark):
    """Lines of one row don't fall to those of another; rows that repeat an id and a text are treated alike."""
    rows = [(1, "a\nb\nc\nd"), (1, "x\ny\nz\na\nb\nc"), (None, "x\ny\nz\nown"), (2, "p\nq\nr"), (2, "p\nq\nr")]
    left = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert "".join(left).count("d") == 1 and "own" in "".join(left) and left.count("p\nq\nr") == 2
    assert sum(t.split("\n").count("a") for t in left) == 1 and sum(t.split("\n").count("y") for t in left) == 1


def test_line_dedup_regular_texts(spark):
    """Texts that a hash modulo a power of two mistakes for each other (Thue-Morse and its complement)."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{morse}\nsame\nlines"), (2, f"{other}\nsame\nlines"), (3, f"{morse}\nsame\nlines\nand more")]
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: rows[0][1], 2: rows[1][1], 3: "and more"}


def test_line_dedup_long_log_and_names(spark):
    """A log of 200,000 lines, half of them repeated, with columns named like the results."""
    lines = [f"line {i}" for i in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join(lines + lines), 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, N_Lines int")
    got = {r.doc_id: r for r in dedup_lines(df, counts=True).collect()}
    assert got[1].text == "\n".join(lines) and (got[1].n_lines, got[1].n_removed) == (200_000, 100_000)
    assert [(got[i].text, got[i].n_lines, got[i].n_removed) for i in (2, 3)] == [(None, 0, 0), ("", 1, 0)]
    assert dedup_lines(df).columns == df.columns


def test_jaccard(spark, docs, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_classes(docs, Scratch(spark)).collect())
    assert [x for x in got if x[0] == 3] == [(3, 11, 3)] * 2 and len(got) == len(ROWS)
    assert near_classes(none, Scratch(spark)).count() == 0


def _components(texts):
    """id -> smallest id that it reaches, by comparing all with all."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    best, at = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for k, a in enumerate(at) for b in at[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    before = None
    while before != best:
        before = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return best, links


def test_jaccard_links_come_through_the_orders(spark):
    """Every link is a candidate of the intersected orders; what they name isn't all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trace = []
    out = near_classes(docs, Scratch(spark), trace=trace)
    assert [t[0] for t in trace] == ["heads", "all"]
    assert all(named >= candidates >= links for _, named, candidates, links in trace)
    classes = out.groupBy("component_id").count().count()
    texts = docs.select("text").distinct().count()
    assert 0 < texts - classes <= sum(t[3] for t in trace) < sum(t[1] for t in trace) < 1000


def test_jaccard_hot_group(spark):
    """A group of near copies that holds half of all rows, and chains through it and beside it."""
    rnd = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rnd.integers(0, 10**6, n)]
    base = words(120)
    texts = {}
    for i in range(200):
        own = list(base)
        for p in rnd.integers(0, 120, 1 + i % 4):
            own[p] = f"x{rnd.integers(0, 10**6)}"
        texts[i] = " ".join(own)
    chain = words(300)
    for i in range(200, 240):  # each near the next two or so, the ends far apart
        texts[i] = " ".join(chain[(i - 200) * 4 : (i - 200) * 4 + 100])
    texts |= {i: " ".join(words(60)) for i in range(240, 400)}
    want, links = _components(texts)
    assert len(links) > 4000 and want[239] == 200
    trace = []
    got = near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Scratch(spark), trace=trace)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert sum(t[1] for t in trace) < len(links) / 2


def test_jaccard_nulls_names_and_long_texts(spark):
    """A null id has the component of an equal text, or none; other columns are no matter; a word and a text of megabytes."""
    a, long = WORDS, " ".join(f"word{i}" for i in range(300_000))
    rows = [(None, a, 1), (7, a, 2), (None, "only here are some words", 3), (8, long, 4), (9, long + " more", 5), (10, "z" * 2_000_000, 6), (11, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_classes(df, Scratch(spark)).collect())
    assert got == [(0, 1, 0), (0, 9, 7), (7, 9, 7), (8, 299_996, 8), (9, 299_997, 8), (10, 1, 10), (11, 0, 11)]


def test_jaccard_frequent_shingles(spark):
    """Shingles dealt by class give the classes that shingles dealt by range give, and those of brute force."""
    import random

    rnd = random.Random(2)
    common = " ".join(f"c{i}" for i in range(40))
    rows, sets = [], {}
    for i in range(120):
        own = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([4, 12, 60]))] if i % 3 else rows[rnd.randrange(len(rows))][1].split()[40:] if rows else []
        words = common.split() + own + ["end"] * (i % 2)
        rows.append((i, " ".join(words)))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    best = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share, sample in ((0.005, 40), (2.0, 40)):
        assert {r.doc_id: r.component_id for r in near_classes(df, Scratch(spark), share=share, sample=sample).collect()} == best


def test_embeddings(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dups(df, Scratch(spark)).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), **{i: (0, i) for i in (3, 4, 5, 6, 7)}}
    assert near_dups(df.limit(0), Scratch(spark)).count() == 0


def test_embeddings_shared_ids_lengths_and_scales(spark):
    """Two vectors with one id, vectors of two lengths, and lengths near the ends of the range of doubles."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1e200, 1e200], 1), (5, [1e-200, 1e-200], 1), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in near_dups(df, Scratch(spark)).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


@pytest.mark.parametrize("cosine", [0.981, 0.985, 0.995])
def test_embeddings_planted_pairs(spark, cosine):
    """Recall of planted pairs by cosine, among vectors that link with nothing else; several chunks a list."""
    rnd = np.random.default_rng(7)
    a = rnd.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rnd.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = cosine * a + (1 - cosine**2) ** 0.5 * b / np.linalg.norm(b, axis=1)[:, None]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(np.stack([a, b], 1).reshape(-1, 64).tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dups(df, Scratch(spark), chunk=64).collect()}
    found = sum(got[i] == (1, i - i % 2) for i in got)
    print("recall", cosine, found / len(got))
    assert found >= 0.95 * len(got) and all(n <= 1 for n, _ in got.values())


@pytest.mark.parametrize("share", [0.1, 0.33])
def test_embeddings_hot_group(spark, share):
    """Links in a large group of near copies, against brute force."""
    rnd = np.random.default_rng(5)
    m = rnd.normal(size=(3000, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    hot = int(share * len(m))
    m[:hot] = m[-1] + 0.09 * m[:hot]
    m = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    d = m.astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    links = (d @ d.T >= 0.98).sum(1) - 1
    assert links.sum() > hot * (hot - 1) * 0.95
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_dups(df, Scratch(spark)).collect()}
    assert all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.95 * links.sum(), sum(got.values()) / links.sum()


def test_passages_and_quality(spark, docs, none):
    assert repeated_passages(docs).count() == 0 and repeated_passages(none).count() == 0
    assert {round(r.score, 6) for r in score_quality(docs, Forest(0.0, [])).collect()} == {0.5}
    assert fit_forest(np.zeros((0, N_FEATURES)), np.zeros(0)).trees == []


def _covered(rows, least):
    """(doc_id -> bytes in windows that occur twice, bytes in windows that occur earlier too), by brute force."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        for p in range(len(text.encode()) - least + 1):
            seen.setdefault(text.encode()[p : p + least], []).append((doc, p))
    for places in seen.values():
        for k, (doc, p) in enumerate(places if len(places) > 1 else []):
            every, gone = out.setdefault(doc, (set(), set()))
            every.update(range(p, p + least))
            gone.update(range(p, p + least) if k else ())
    return out


def test_passages_brute_force(spark):
    """Passages of 51 words and around the threshold, copies, and texts of few distinct words, byte for byte."""
    import random

    rnd = random.Random(4)
    words = lambda n, of=10**6: " ".join(f"w{rnd.randint(0, of)}" for _ in range(n))
    rows = []
    for i in range(60):
        shared = words(51) if i % 3 else words(rnd.randint(13, 18))
        if i % 5 == 0:
            shared = " ".join(["ab", "é"] * rnd.randint(20, 60))
        rows += [(2 * i, f"{words(30)} {shared} {words(20)}"), (2 * i + 1, f"{words(9)} {shared}{words(40)}")]
    rows += [(200, rows[7][1]), (201, rows[7][1]), (202, "a" * 400), (203, "x" + "a" * 121), (204, "b" * 119), (205, "c" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _covered(rows, 120)
    assert len(want) > 90
    got = {r.doc_id: r for r in repeated_passages(df).collect()}
    assert {d: {p for x in r.spans for p in range(x.start, x.end)} for d, r in got.items()} == {d: w[0] for d, w in want.items()}
    assert {d: r.n_removable for d, r in got.items()} == {d: len(w[1]) for d, w in want.items()}


def test_passages_by_words_and_removal(spark):
    """Passages of fewer words than asked for stay; the text without the removable spans is what is left."""
    rnd = np.random.default_rng(6)
    words = lambda n: " ".join(f"é{x}" for x in rnd.integers(0, 10**6, n))
    long, short = words(51), words(30)
    rows = [(1, f"{words(20)} {long} {words(20)}", "a"), (2, f"{words(30)}. {long}", "b"), (3, f"{words(9)}; {short}", "c"), (4, f"{short}: {words(9)}", "d"), (5, None, "e"), (None, long, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    assert {r.doc_id for r in repeated_passages(df, words=50).collect()} == {1, 2, None}
    assert {r.doc_id for r in repeated_passages(df, words=30).collect()} == {1, 2, 3, 4, None}
    left = remove_passages(df, words=50)
    assert left.columns == df.columns
    got = {r.row: r.text for r in left.collect()}
    assert got == {"a": rows[0][1], "b": rows[1][1][: -len(long) - 1], "c": rows[2][1], "d": rows[3][1], "e": None, "f": ""}


def test_pipeline_near_duplicates_keeps_one_row(spark):
    """Rows that repeat an id, or have none, are rows of their own; one of each group stays."""
    import corpus_pipeline

    one, two, three = WORDS, WORDS[::-1], "some other words that stand here once"
    rows = [(3, one, 1), (3, one, 2), (None, one, 3), (5, one, 4), (None, two, 5), (None, two, 6), (7, three, 7), (7, one, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    left = corpus_pipeline.near_duplicates(spark, df, "")
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, two), (3, one), (7, three)]
    unique = spark.createDataFrame([(4, one, 1), (2, one, 2), (9, two, 3)], df.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, unique, "").collect()) == [2, 9]


def test_passages_null_ids_and_removable(spark):
    """Null ids come last; what repeats within one document counts; the kept occurrence is not removable."""
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two"))
    a, b = len(one), len(two)
    df = spark.createDataFrame([(None, f"x {one}"), (2**60 + 1, one), (4, f"{two} | {two}"), (9, "no passage here")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.spans], [tuple(x) for x in r.removable]) for r in repeated_passages(df).collect()}
    assert got == {None: ([(2, 2 + a)], [(2, 2 + a)]), 2**60 + 1: ([(0, a)], []), 4: ([(0, b), (b + 3, 2 * b + 3)], [(b + 3, 2 * b + 3)])}
