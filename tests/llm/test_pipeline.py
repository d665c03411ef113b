"""The pipeline's stages, each against a plain version of what it should do to its own input."""

import pytest
import sentencepiece

import corpus_pipeline
from .test_decontaminate import brute as brute_windows
from .test_near_duplicates import brute as brute_copies
from urlgauge.llm.pieces import DEFAULT_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_first_bytes(docs, window=200):
    """Texts without each byte that an earlier-started window covers."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            key = data[at : at + window]
            if key in seen:
                gone[at : at + window] = b"\x01" * window
            seen.add(key)
        out[doc] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else text
    return out


def test_stages_on_the_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    texts = {d: t for d, t in docs.select("doc_id", "text").collect()}
    for (name, stage), step in zip(corpus_pipeline.STAGES, range(len(names)), strict=True):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{step}")
        docs = spark.read.parquet(f"{tmp_path}/{step}")
        got = {r.doc_id: r for r in docs.collect()}
        if step < 4:
            assert docs.columns == COLUMNS
        if step == 0:
            assert {d: r.text for d, r in got.items()} == texts  # every document of this table has a known language
        if step == 1:
            assert set(got) == {d for d, _, c in brute_copies(list(texts.items())) if d == c}
        if step == 2:
            want = keep_first_bytes(texts.items())
            assert {d: r.text for d, r in got.items()} == want
            assert all(r.n_chars == len(r.text) for d, r in got.items() if want[d] != texts[d])
        if step == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(got) == {r[0] for r in brute_windows(list(texts.items()), items) if not r[5]}
        if step == 4:
            library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
            assert all(r.ids == library.encode(r.text) and r.round_trip for r in got.values())
        texts = {d: r.text for d, r in got.items()}
    assert 0 < len(texts)


@pytest.mark.parametrize("rows", [0, 1])
def test_odd_tables(spark, tmp_path, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, row string"
    odd = [(1, None, "en", "a", 0, 1, "x"), (2, "", None, None, None, None, None), (None, "a line", "en", "a", 6, 1, "x"), (3, "same words in this line here", "en", "b", 28, 2, "y"), (3, "same words in this line here", "en", "b", 28, 2, "y"), (4, "x", "de", "b", 1, 2, "y")]
    spark.createDataFrame(odd if rows else [], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not there at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not rows:
        assert not got
    else:
        assert {r.doc_id for r in got} <= {None, 3, 4} and len([r for r in got if r.doc_id == 3]) == 1
