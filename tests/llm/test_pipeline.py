"""The pipeline's rows against a plain version of its stages."""

import random
import re

import corpus_pipeline
import sentencepiece

from quern.llm import mixing, quality_rules, sentencepiece_codec, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if name != "mixing" else docs.collect()

    clean = {r.row.doc_id: r.clean_text for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    assert kept["quality_rules"] == clean
    last = {}
    for d, t in sorted(clean.items()):
        last[re.sub("[A-Z]", lambda m: m[0].lower(), t)] = d
    exact = {d: clean[d] for d in last.values()}
    assert kept["exact_dedup"] == exact
    # linked: fingerprints of at most two bits apart, or five-word shingles with a similarity of 0.8 or more
    fps, sets = {d: simhash.fingerprint(t) for d, t in exact.items()}, {}
    for d, t in exact.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    link = {d: [e for e in exact if ((fps[d] ^ fps[e]) & (2**64 - 1)).bit_count() <= 2 or 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) > 0] for d in exact}
    group = {d: d for d in exact}
    for _ in range(len(exact)):
        new = {d: min(group[e] for e in link[d]) for d in exact}
        if new == group:
            break
        group = new
    near = {d: exact[d] for d in exact if group[d] == d}
    assert kept["simhash_near_dedup"] == near

    taken = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    words = dict.fromkeys(near, 0)
    for r in kept["mixing"]:
        n = len(r.text.encode().split())
        words[r.doc_id] += n
        assert r.n_chars == len(r.text) and (r.text == near[r.doc_id] or n < len(near[r.doc_id].encode().split()))
    assert words == taken

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = sorted((r.doc_id, library.encode(r.text)) for r in kept["mixing"])
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_odd_and_empty_input(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an extra column with a work name; and no rows at all."""
    draw = random.Random(2)
    good, long = ("\n".join(" ".join(f"{draw.choice('abcdef')}{draw.randint(0, 9999)}" for _ in range(12)) + "." for _ in range(n)) for n in (8, 9000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, good.upper(), None, None, None, None), (None, good + " No id.", None, None, None, None), (3, None, "en", "a", 1, "y"), (4, "", "en", "b", 0, "y"), (5, long, "en", "b", 1, "z")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} <= {1, 2, None, 5} and any(r.doc_id == 5 for r in got) and all(r.round_trip for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_words_of_the_older_generation_stay(monkeypatch):
    """A full generation of words is not forgotten at once: those met again move on, with the same ids."""
    from pathlib import Path

    codec = sentencepiece_codec.Codec(Path(sentencepiece_codec.MODEL).read_bytes())
    text = "many quite ordinary words stand here"
    first = codec.encode(text).tolist()
    monkeypatch.setattr(sentencepiece_codec, "WORD_BYTES", codec.word_bytes)
    codec.encode("another")
    assert "ordinary" in codec.old and "ordinary" not in codec
    monkeypatch.setattr(codec, "ids", None)
    assert codec.encode(text).tolist() == first and "ordinary" in codec
