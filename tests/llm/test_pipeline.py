"""Each stage of the pipeline against brute force, on what the one before it left; and the whole run."""

import hashlib
import re

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline as P
from graphloom.llm import queries as Q
from graphloom.llm.quality import fit_quality, score_quality

SF = "/root/testdata/sf0.001"


def _lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        own = (text or "").split("\n")
        gone = set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = text if not gone else "\n".join(x for p, x in enumerate(own) if p not in gone)
    return out


def near(rows):
    sets = {}
    for i, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    best = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in linked:
        before = dict(best)
        for a, b in linked:
            best[a] = best[b] = min(best[a], best[b])
        if best == before:
            break
    return {i: rows[i] for i in rows if best[i] == i}


def clean(rows, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for text in bench:
        w = word.findall(_lower(text or ""))
        windows |= {tuple(w[p : p + min(13, len(w))]) for p in range(max(1, len(w) - 12))} if w else set()
    out = {}
    for i, text in rows.items():
        w = word.findall(_lower(text or ""))
        hit = {q for n in {len(x) for x in windows} for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for q in range(p, p + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = text
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> rows (doc_id -> text, or the last stage's), each read again from Parquet as the next one's input."""
    at = tmp_path_factory.mktemp("pipeline")
    docs = Q.table(spark, SF, "documents")
    out, columns = {"documents": {r.doc_id: r.text for r in docs.collect()}}, docs.columns
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if name != "bpe":
            assert docs.columns == columns
            out[name] = {r.doc_id: r.text for r in docs.collect()}
    out["bpe"] = {r.doc_id: r for r in docs.collect()}
    return out


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_quality(spark, stages):
    """What the classifier of op7 rejects goes, and nothing else."""
    docs = Q.table(spark, SF, "documents").select("doc_id", "text")
    kept = {r.doc_id for r in score_quality(docs, fit_quality(docs, Q.table(spark, SF, "labels"))).where("predicted = 1").collect()}
    assert set(stages["quality"]) == kept and 0 < len(kept) < len(stages["documents"])


def test_lines(stages):
    assert stages["line_dedup"] == lines(stages["quality"])


def test_near_duplicates(stages):
    assert stages["near_duplicates"] == near(stages["line_dedup"])
    assert len(stages["near_duplicates"]) < len(stages["line_dedup"])


def test_decontamination(spark, stages):
    bench = [r.text for r in Q.table(spark, SF, "benchmark").collect()]
    assert stages["decontamination"] == clean(stages["near_duplicates"], bench)
    assert len(stages["decontamination"]) < len(stages["near_duplicates"])


def _digests(texts):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {i: (len(e.ids), sha(" ".join(map(str, e.ids))), sha(lib.decode(e.ids, skip_special_tokens=False))) for i, e in zip(texts, lib.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}


def test_bpe(stages):
    got = {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in stages["bpe"].items()}
    assert got == _digests(stages["decontamination"])


def test_run(spark, stages):
    assert {(r.doc_id, r.ids_sha256) for r in P.run(spark, SF).collect()} == {(i, r.ids_sha256) for i, r in stages["bpe"].items()}


def test_empty_and_odd_rows(spark):
    """No rows; null and empty texts, repeated rows and null ids, through every stage but the first."""
    docs = Q.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "s", 0), (1, "", "x", "s", 0), (2, None, None, None, None), (3, "a b c", "x", "s", 5), (3, "a b c", "x", "s", 5), (None, "y " * 60_000, None, None, 1)], docs.schema)
    for rows, left in ((docs.limit(0), 0), (odd, 6)):
        now = rows
        for _, stage in P.STAGES[1:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        assert P.STAGES[-1][1](spark, now, SF).count() == left


def test_op2_query(spark):
    docs = {r.doc_id: r.text for r in Q.table(spark, SF, "documents").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op2_bpe(spark, SF).collect()} == _digests(docs)


def test_op3_query(spark):
    docs = {r.doc_id: r.text or "" for r in Q.table(spark, SF, "documents").collect()}
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(e.ids) for i, e in zip(docs, lib.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op3_token_counts(spark, SF).collect()} == {i: (len(t.encode()), n[i], n[i] > 512) for i, t in docs.items()}
