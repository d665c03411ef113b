import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from urlgauge.llm.pieces import DEFAULT_MODEL, Transducer, decode_pieces, encode_pieces, op8_query


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


def test_same_ids_as_the_library(library):
    own, rng = Transducer(DEFAULT_MODEL), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abcdeest thein  \n\té▁#1290ABß中文😀\x00\"().") for _ in range(rng.randrange(40)))
        assert own.encode(text) == library.encode(text)
    for text in ("", " ", " " * 50, "a" * 3000, "▁▁ x"):
        assert own.encode(text) == library.encode(text)


def unigram_file(path, pieces):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = True
    model.normalizer_spec.escape_whitespaces = True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((p, s, 1) for p, s in pieces)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_unigram_is_the_least_path(tmp_path):
    rng = random.Random(6)
    pieces = {"▁": -4.0, "a": -3.0, "b": -3.5, "c": -5.0}
    while len(pieces) < 40:
        pieces["".join(rng.choice("abc▁") for _ in range(rng.randrange(2, 5)))] = -rng.uniform(2, 9)
    path = unigram_file(tmp_path / "own.model", pieces.items())
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Transducer(path)
    for _ in range(300):
        text = "".join(rng.choice("abcx ") for _ in range(rng.randrange(12)))
        ids = own.encode(text)
        weigh = lambda ids: sum(-library.get_score(i) if i != 0 else 0 for i in ids)
        assert abs(weigh(ids) - weigh(library.encode(text))) < 1e-4
        if "x" not in text:
            assert own.decode(ids) == library.decode(ids)


def test_rows(spark):
    texts = [(1, "one two  three\n"), (1, "one two  three\n"), (2, None), (3, ""), (None, "é 中"), (4, "word " * 40000), (5, "x" * 5000), (6, " lead and trail ")]
    df = spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id bigint, text string, ids string, n_ids int")
    got = encode_pieces(df)
    assert got.columns == ["doc_id", "text", "n_ids", "ids", "round_trip"]
    rows = got.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    back = decode_pieces(got.withColumn("was", got.text)).collect()
    assert all(r.text == (r.was or "") for r in back)
    assert encode_pieces(df.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, library, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (len(ids := library.encode(t)), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True) for d, t in docs}
    got = {r.doc_id: tuple(r)[1:] for r in op8_query(spark, f"/root/testdata/{sf}").collect()}
    assert got == want


def test_pairs_are_worked_out_once_for_all_tasks_of_a_worker(library):
    own, asked = Transducer(DEFAULT_MODEL), []
    scores = type("Scores", (dict,), {"get": lambda self, piece: asked.append(piece) or dict.get(self, piece)})
    own.scores = scores(own.scores)
    text = "Thhendsh undschpfber tihash. ofaninenan cióníqueos Êêelle 中😀ß\x00 " * 2
    assert own.encode(text) == library.encode(text) and asked
    kept = dict(own.pairs)
    own.forget()  # as at the end of a task
    assert not own.pairs and not own.known and own.packed.nbytes == 8 * len(kept)
    first = len(asked)
    assert own.encode(text) == library.encode(text) and len(asked) == first and own.pairs == kept  # each anew before
    assert not own.known.older and len(own.known) == len(set(own.parts.findall(own.normalise(text))))


def test_parts_that_leave_the_store_are_found_again(library, monkeypatch):
    monkeypatch.setattr("urlgauge.llm.pieces.KEPT_PARTS", 3)
    monkeypatch.setattr("urlgauge.llm.pieces.KEPT_PAIRS", 5)
    own, rng = Transducer(DEFAULT_MODEL), random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choice(["one", "twofold", "thräe", "中文", "hash###", "x" * 70, "ofaninenan"]) for _ in range(20))
        assert own.encode(text) == library.encode(text)
        assert len(own.known) <= 3 and len(own.known.older) <= 3 and len(own.pairs) <= 5
