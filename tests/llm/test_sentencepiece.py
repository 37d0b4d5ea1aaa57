"""The transducer against the library, and its round trip."""

import random
import zlib
from array import array
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import sentencepiece_fst as S

library = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not Path(S.MODEL).exists(), reason="no model file here")

TEXTS = ["Hello  world", "  a\tb\nc ", "", "é x ①ﬁ", "a\r\nb", "​漢字🙂", "aaaaaaa bbbbbbbbb     x", "<s> </s> <0x0A> <unk>", "ﬁ    \n\n\n  def f(x):\n        return 1", "한국어 テスト क्षि", " ", "x" * 3000, "the " * 2000, "\x00\x01"]


@pytest.fixture(scope="module")
def both():
    return S.compile_model(), library.SentencePieceProcessor(model_file=S.MODEL)


def test_equal_to_library(both):
    ours, theirs = both
    r = random.Random(0)
    letters = "abcdeéß thin  erationsß\n\t.,①漢🙂▁ "
    for text in TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(400)]:
        ids = theirs.encode(text)
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids), text


def test_round_trip(both):
    ours, _ = both
    for text in TEXTS:
        assert ours.decode(ours.encode(text)) == text


def changed(**norm):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(Path(S.MODEL).read_bytes())
    for k, v in norm.items():
        setattr(model.normalizer_spec, k, v)
    return model


@pytest.mark.parametrize("norm", [{"add_dummy_prefix": False}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False, "remove_extra_whitespaces": True}])
def test_normaliser_follows_the_specification(norm):
    proto = changed(**norm).SerializeToString()
    ours, theirs = S.compile_spec(proto), library.SentencePieceProcessor(model_proto=proto)
    for text in TEXTS + ["   ", " a  b ", "a   "]:
        assert ours.encode(text) == theirs.encode(text), text
        assert ours.decode(ours.encode(text)) == theirs.decode(theirs.encode(text)), text


def test_other_specifications_are_refused():
    for change in ("charsmap", "suffix", "word", "user"):
        model = changed()
        if change == "charsmap":
            model.normalizer_spec.precompiled_charsmap = b"x"
        elif change == "suffix":
            model.trainer_spec.treat_whitespace_as_suffix = True
        elif change == "word":
            model.trainer_spec.model_type = 3
        else:
            model.pieces[400].type = 4
        with pytest.raises(ValueError, match="not supported"):
            S.compile_spec(model.SerializeToString())


def test_unigram_model_equals_the_library():
    """A unigram model put together by hand: weights in eighths, so the cheapest path is not the longest match, and ties occur."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(1)
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True))
    names = {"▁": -3.0} | {c: -4.5 - k / 8 for k, c in enumerate("abcdé漢")}
    while len(names) < 90:
        names["".join(r.choice("abcdé▁") for _ in range(r.randint(2, 5)))] = -r.randint(24, 112) / 8
    for piece, score, type_ in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in names.items())]:
        model.pieces.add(piece=piece, score=score, type=type_)
    proto = model.SerializeToString()
    ours, theirs = S.compile_spec(proto), library.SentencePieceProcessor(model_proto=proto)
    for _ in range(500):
        text = "".join(r.choice("abcdé漢  ") for _ in range(r.randint(1, 40)))
        assert ours.encode(text) == theirs.encode(text), text


def test_costs_are_compared(both):
    """The shortest path over all segmentations, by brute force with the same weights, is the one that is found; in words it is the only finite one."""
    ours, _ = both

    def paths(text, before=-1):
        if not text:
            yield 0.0, []
        for k in range(1, len(text) + 1):
            i = ours.ids.get(text[:k], S.CHAR + ord(text) if k == 1 and len(text) == 1 else None)
            if i is not None:
                for c, rest in paths(text[k:], i):
                    yield (0.0 if before < 0 else ours.weight(before, i)) + c, [i, *rest]

    for text in ["thinking", "unseen", "abra", "Ideas", "returns"]:
        finite = [p for c, p in paths(S.MARK + text) if c < S.INFINITY]
        assert finite == [ours.path(S.MARK + text)], text


def test_unigram_weights_give_the_cheapest_path():
    pieces = ["<unk>", "▁", "▁a", "ab", "b", "abc", "c", "▁ab"]
    score = [0, -5, -2, -1.5, -2, -6, -3, -2.2]
    fst = S.Transducer("unigram", pieces, {p: i for i, p in enumerate(pieces) if i}, score, [], 0)

    def best(text):
        if not text:
            return 0.0, []
        options = [(best(text[len(p) :])[0] - score[i], [i, *best(text[len(p) :])[1]]) for p, i in fst.ids.items() if text.startswith(p)]
        if text[0] not in fst.ids:
            options.append((best(text[1:])[0] - fst.floor, [0, *best(text[1:])[1]]))
        return min(options)

    for text in ["ab", "abc", "abcabc", "a b c", "xab", "abz"]:
        assert fst.encode(text) == best(fst.normalise(text))[1], text


def test_tables(spark, both):
    _, theirs = both
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(0))
    model = S.compile_model()
    encoded = S.encode_table(df, model)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in encoded.collect()) == sorted((i if i is not None else -1, theirs.encode(t or "")) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in S.decode_table(encoded, model).collect()) == sorted((i if i is not None else -1, t or "") for i, t in rows)
    for r in S.summarise(df, model).collect():
        if r.doc_id is not None:
            ids = theirs.encode(TEXTS[r.doc_id])
            assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(array("i", ids).tobytes()), True)
            assert r.n_byte_tokens == sum(theirs.is_byte(i) for i in ids)
    assert S.summarise(df.limit(0), model).count() == 0
