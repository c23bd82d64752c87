import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from helpers import DOCS, ODD, frame
from tokenizers import Tokenizer

from tokenledger.llm import alignment as m
from tokenledger.llm.tokens import piece_units, vocabulary_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    a = Tokenizer.from_file(P.path(m.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path(m.SECOND))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(k): k for k in own} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in own)}
    bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, bytes_a, piece


def by_hand(docs):
    """Rows of the query by the libraries on whole texts and loops over byte ranges."""
    a, b, bytes_a, piece = libraries()
    told = []
    for key, text in docs:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        parts_a, parts_b = [bytes_a[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            told.append((key, [], [], [], ""))
            continue
        spans = []
        for parts in (parts_a, parts_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, lo = [], 0
        for x, (s, e) in zip(ids_a, spans[0]):
            while spans[1][lo][1] <= s:
                lo += 1
            for k in range(lo, len(spans[1])):
                if spans[1][k][0] >= e:
                    break
                links.append((x, ids_b[k]))
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            x, y = [], []
            while i < len(ids_a) and spans[0][i][1] <= end:
                x.append(ids_a[i])
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= end:
                y.append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        told.append((key, ids_a, ids_b, links, ";".join(groups)))
    counts = Counter(x for t in told for x in t[3])
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (key, len(x), len(y), groups.count(";") + 1 if x else 0, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if x else "")
        for key, x, y, links, groups in told
    ]


def texts():
    rng = random.Random(2)
    alphabet = "aáb é中😀 \n\t\r  .,!12<s>▁'" + "ßñİﬁ　\xa0́"
    odd = ["▁", "a ▁b", "<s> </s> <unk> <0x41>", "  ", " a", "a  ", "\n\n a\n", "\r\n", "x" * 300 + " y", "'s 'll it's", "no\x00nul \x00", "ab ab\nab"]
    return ODD + odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(150)] + ["the cat sat on the mat, and the dog " * 20, "que la mañana del día " * 30]


def same(spark, docs, parts=3):
    got = m.alignment_digest(m.aligned(frame(spark, docs).repartition(parts)))
    assert got.columns == COLUMNS
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got.collect()) == text(by_hand(docs))


def test_rows_equal_loops_over_byte_ranges(spark):
    same(spark, [*enumerate(texts()), (3, "again"), (3, "again"), (None, "no key")])


def test_pairs_met_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    same(spark, list(enumerate(texts())))


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(4000))
    docs = [long, "short one", long + "\n" + "z" * 9000, ""]
    monkeypatch.setattr(m, "CHUNK_BYTES", 1000)
    parted = m.Aligner(vocabulary_path(m.FIRST), vocabulary_path(m.SECOND))
    assert len(list(parted.parts(docs))) > 20
    got = [r[:5] for r in parted(docs)]
    want = [(*r[1:5], r[7]) for r in by_hand(list(enumerate(docs)))]
    assert [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in got] == want


def test_units_of_pieces_are_those_of_whole_texts():
    own = piece_units(vocabulary_path(m.SECOND))
    assert own.by_units
    _, b, _, _ = libraries()
    rng = random.Random(9)
    made = ["".join(rng.choice(" \n\ra.é中<s▁\x00'1") for _ in range(rng.randrange(1, 25))) for _ in range(20_000)] + [t for t in texts() if t]
    got = own.ids(made)
    assert [len(x) // 4 for x in got] == [len(x) for x in b.encode(made)]
    assert all(x == m.np.array(y, "<u4").tobytes() for x, y in zip(got, b.encode(made)))


@pytest.mark.parametrize("extra", ["pair", "groups", "key"])
def test_extra_columns_and_an_empty_table(spark, extra):
    rows = frame(spark, [(1, "a b")]).withColumn(extra, m.F.lit("x"))
    assert m.alignment_digest(m.aligned(rows)).first().n_a == 2
    assert m.alignment_digest(m.aligned(spark.createDataFrame([], DOCS))).count() == 0
