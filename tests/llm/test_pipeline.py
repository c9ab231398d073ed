"""The stages one after another: columns, whole rows, and decisions against brute force."""

import random

import corpus_pipeline
from kestrelq.llm import packing, secrets, wordpieces
from kestrelq.llm.common import written

SMALL = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    cost = secrets.GuessCost()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, SMALL))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "language ID":
            assert len(after) >= 0.97 * len(before)
        if name == "secret scans":
            assert after == before
    for r in docs.collect():
        assert not secrets.find_secrets(r.text, cost, 8.0)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in placed.collect()} == after


def brute_lines(rows):
    """Text without the lines that stand on ten sites or more, but in their first document; None where nothing else was."""
    sites, first = {}, {}
    for i, text, _, site, _ in rows:
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            sites.setdefault(line, set()).add(site)
            first[line] = min(i, first.get(line, i))
    out = {}
    for i, text, *_ in rows:
        gone = [x.strip(" ") != "" and len(sites[x.strip(" ")]) >= 10 and i > first[x.strip(" ")] for x in text.split("\n")]
        full = [x.strip(" ") != "" for x in text.split("\n")]
        if not any(gone) or sum(gone) < sum(full):
            out[i] = "\n".join(x for x, g in zip(text.split("\n"), gone) if not g)
    return out


def brute_survivors(texts):
    """Of each class over links of at least 0.8 on runs of five words, the least id."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    above = {i: i for i in texts}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {i for i in ids if root(i) == i}


def test_decisions_are_those_of_brute_force(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    banner = "All rights reserved by the very same owner of these pages"
    rows = []
    for i in range(60):
        body = " ".join(word() for _ in range(rng.randint(15, 60)))
        if i % 6 == 1:
            body = rows[-1][1].split("\n")[0]  # a copy of the one before
        if i % 6 == 2:
            w = rows[-2][1].split("\n")[0].split()
            w[len(w) // 2] = "changed"
            body = " ".join(w)
        secret = f"\npassword = {'Zx9!' + word() + 'Q7#' + word()}" if i % 7 == 3 else ""
        rows.append((i, body + ("\n" + banner if i % 2 else "") + secret, "en", f"site{i % 15}", len(body)))
    rows.append((60, banner, "en", "site1", 5))
    docs = spark.createDataFrame(rows, DOCUMENT)
    stage = dict(corpus_pipeline.STAGES)
    lines = {r.doc_id: r for r in stage["line dedup"](spark, docs, "").collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in lines.items()} == want and 60 not in lines
    assert all(r.n_chars == (len(r.text) if r.text != rows[i][1] else rows[i][4]) for i, r in lines.items())
    cleaned = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in lines.values()], DOCUMENT)
    kept = stage["n-gram Jaccard join"](spark, cleaned, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(brute_survivors(want)) and len(kept) < len(want)
    clear = stage["secret scans"](spark, spark.createDataFrame(kept, DOCUMENT), "").collect()
    cost = secrets.GuessCost()
    for before, r in zip(sorted(kept), sorted(clear)):
        spans = secrets.find_secrets(before.text, cost, 8.0)
        assert r.doc_id == before.doc_id and r.text == secrets.redact(before.text, spans) and ("[secret]" in r.text) == bool(spans)
    assert any("[secret]" in r.text for r in clear)
    encode = wordpieces.encoder(wordpieces.default_vocabulary())
    lengths = {}
    for r in clear:
        lengths[r.doc_id] = len(encode.encode([r.text])[0]) // 4 + 1
    placed = stage["best-fit packing"](spark, spark.createDataFrame(clear, DOCUMENT), "").collect()
    assert {r.doc_id: r.length for r in placed} == lengths
    assert len({r.sequence_id for r in placed}) == packing.least_sequences({n: list(lengths.values()).count(n) for n in lengths.values()}, 4096)


def test_documents_of_no_known_language_go(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the of and in is this that with from have".split()) for _ in range(40)), "en", "s", 9) for i in range(30)]
    rows += [(100, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400)), None, "s", 9), (101, "12345 67890", None, "s", 9), (102, None, "en", "s", None), (103, "", "en", "s", 0)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCUMENT), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_run_and_missing_values(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "The of and in is this text", "en", "a", 26), (4, "The of and in is this text", "en", "b", 26), (None, "And in the", None, "c", 10)]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCUMENT + ", _kq_id int, comp int, `first` string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {3, None}


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
