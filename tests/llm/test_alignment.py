"""Cross-tokenizer alignment against a plain pointer walk over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwarden.llm import alignment
from millwarden.llm.queries import QUERIES, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled(libraries, text):
    """Whole texts by the libraries: [(id, bytes)] of A and of B."""
    a, b = libraries
    letters = alignment.byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.id_to_piece(k).startswith("<0x") else b.id_to_piece(k).replace("▁", " ").encode()
    return [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in ids_a], [(k, piece(k)) for k in ids_b]


def plain(libraries, text):
    """n_a, n_b, groups as text, links of whole ``text``."""
    if not text:
        return 0, 0, "", []
    a, b = spelled(libraries, text)
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode():
        return 0, 0, "", []
    links, groups, at_a, at_b = [], [([], [])], 0, 0
    starts_b, total = [], 0
    for _, x in b:
        starts_b.append(total)
        total += len(x)
    ends_a = set(np.cumsum([len(x) for _, x in a]).tolist())
    ends = ends_a & set(np.cumsum([len(x) for _, x in b]).tolist())
    low = 0
    for k, x in a:
        high = at_a + len(x)
        while low < len(b) and starts_b[low] + len(b[low][1]) <= at_a:
            low += 1
        j = low
        while j < len(b) and starts_b[j] < high:
            links.append((k, b[j][0]))
            j += 1
        at_a = high
    parts, cut = [], 0
    spots_a, spots_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
    i = j = 0
    for end in sorted(ends):
        left, right = [], []
        while i < len(a) and spots_a[i] <= end:
            left.append(str(a[i][0]))
            i += 1
        while j < len(b) and spots_b[j] <= end:
            right.append(str(b[j][0]))
            j += 1
        parts.append(",".join(left) + "|" + ",".join(right))
    return len(a), len(b), ";".join(parts), links


def expected(libraries, rows):
    done = [(k, plain(libraries, t)) for k, t in rows]
    counts = Counter(x for _, d in done for x in d[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((k, n_a, n_b, len(groups.split(";")) if groups else 0, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(groups.encode()).hexdigest() if n_a else "") for k, (n_a, n_b, groups, links) in done), key=str)


def collected(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def odd_rows():
    rng = random.Random(13)
    bits = list("abAB .,  \n\t!é'ßж漢▁́ \x1f0<|>") + ["<|endoftext|>", "<unk>", "<s>", "</s>", "<0x41>", " the ", " and", "'s ", "\r\n", " foo bar", "İ", "😀", "ﬁ", "½"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 50)))) for k in range(600)]
    long_text = " ".join(rng.choice(["word", "Überlänge", "naïve,", "x9z", "end."]) + str(rng.randrange(50)) for _ in range(30_000))
    return rows + [(1, "repeated key"), (1, "repeated key"), (None, "no key"), (None, None), (7000, None), (7001, ""), (7002, long_text), (7003, "x" * 50_000), (7004, " "), (7005, " leading"), (7006, "trailing ")]


def test_alignment_against_a_pointer_walk(spark, libraries):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("own"), "pair": F.lit("own"), "KEY": F.lit(1)})
    want = expected(libraries, rows)
    assert sum(w[1] > 0 for w in want) > 300
    for batch_bytes, most_pairs in ((3000, 10**6), (1 << 22, 0)):
        assert collected(alignment.align(frame, A, B, batch_bytes=batch_bytes, most_pairs=most_pairs)) == want
    assert alignment.align(frame.limit(0), A, B).count() == 0


def test_query_on_whole_table(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert collected(QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001")) == expected(libraries, rows)


def test_lockstep_of_no_lanes():
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in alignment.lockstep(none, none, none, none)] == [0, 0, 0, 0]
