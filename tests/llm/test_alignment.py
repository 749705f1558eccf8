"""Alignment of two tokenizers against plain Python on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment
from plumbline.llm.alignment import Aligner, Vocabulary, align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "\n", "x\n\ny", "tab\tand\x0bmore ", "日本語 テキスト　です", "ﬁ ① é é", "<s> </s> <0x41> <|endoftext|>", "▁ mark", "a▁b", "\x00 \x01", "\x1c \x85 x", "   lead", "don't  we'll", "é" * 50, "12345 67,8", "🙂🙂 a🙂", " \t ", "a  b", "end \n"]


def whole_texts():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    vocabulary = Vocabulary(A)

    def cut(text):
        """A's and B's (id, end) of a text, each without tokens if the bytes differ."""
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        pieces = [bytes([b.id_to_piece(i).startswith("<0x") and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        if not text or b"".join(pieces) != (" " + text).encode() or b"".join(vocabulary.bytes[i] for i in one) != (" " + text).encode():
            return [], []
        return [[(i, sum(map(len, parts[: k + 1]))) for k, i in enumerate(ids)] for ids, parts in ((one, [vocabulary.bytes[i] for i in one]), (two, pieces))]

    return cut


def groups_of(one, two):
    """Ids of both sides between bytes at which both end."""
    both = {e for _, e in one} & {e for _, e in two}
    out, group = [], ([], [])
    for e, side, i in sorted([(e, 0, i) for i, e in one] + [(e, 1, i) for i, e in two]):
        group[side].append(i)
        if e in both and side == 1:
            out.append(group)
            group = ([], [])
    return out


def links_of(one, two, kind):
    if kind == "ends":
        ends = {e: i for i, e in two}
        return [(i, ends[e]) for i, e in one if e in ends]
    spans = lambda x: [(i, s, e) for (i, e), s in zip(x, [0, *[e for _, e in x]])]
    return [(i, j) for i, s, e in spans(one) for j, t, f in spans(two) if s < f and t < e]


def brute(rows, kind="ends"):
    cut = whole_texts()
    cuts = [(doc, *cut(text or "")) for doc, text in rows]
    counts = Counter(x for _, one, two in cuts for x in links_of(one, two, kind))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc, one, two in cuts:
        groups, links = groups_of(one, two), links_of(one, two, kind)
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(one), len(two), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if one else ""))
    return out


def of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("kind,frequent", [("ends", 200_000), ("ends", 20), ("overlaps", 50)])
def test_equals_whole_texts(spark, docs, edge, kind, frequent):
    rows = [(r[0], r[1]) for r in [*docs.select("doc_id", "text").limit(60).collect(), *edge.select("doc_id", "text").collect()] if kind == "ends" or len(r[1] or "") < 900]
    rows += [(1000 + k, x) for k, x in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert of(align(table, A, B, links=kind, frequent=frequent)) == sorted(brute(rows, kind), key=str)


def test_a_small_memory_of_units(spark, docs, monkeypatch):
    texts = [r[0] for r in docs.select("text").limit(40).collect()]
    monkeypatch.setattr(alignment, "MOST_UNITS", 50)
    one, many = Aligner(A, B, "ends"), Aligner(A, B, "ends")
    got = [one.documents([t]) for t in texts]
    sums, digests, _ = many.documents(texts)
    assert [g[1][0] for g in got] == digests and [tuple(g[0][0]) for g in got] == [tuple(s) for s in sums]


def test_units_are_met_in_slices(docs, monkeypatch):
    texts = [r[0] for r in docs.select("text").limit(40).collect()] + ["a▁b", "end "]
    want = Aligner(A, B, "ends").documents(texts)
    monkeypatch.setattr(alignment, "BLOCK", 500)
    got = Aligner(A, B, "ends").documents(texts)
    assert (got[0] == want[0]).all() and got[1] == want[1] and got[2].equals(want[2])


def test_ids_are_the_tokenizers(docs):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    own, rng = Vocabulary(A), random.Random(1)
    texts = [*ODD, *["".join(rng.choice("ab é日\n\t  '.1x🙂 ") for _ in range(60)) for _ in range(300)], *[r[0] or "" for r in docs.select("text").limit(50).collect()]]
    for x in texts:
        assert own.encode(x) == t.encode(" " + x, add_special_tokens=False).ids


def test_empty_table(none):
    assert of(align(none, A, B)) == []
