"""Cross-tokenizer alignment against the definition, by the tokenizers' own libraries."""
import cProfile
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricelab.llm import alignment
from pricelab.llm.chunks import byte_alphabet
from pricelab.llm.queries import op13_tokenizer_alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", None, " ", "  a  b \n c", "foo\n  bar", "x \n\n y  ", "a\tb ", "<|endoftext|> hi </s>", "日本 語  テスト", "▁ mark",
       "it's 'll  don't", "é 🙂🙂   x", "aé" * 3000, " lead", "\x1c \x85 c", "<0x41> nul\x00 l", "the the the", "the"]


def brute_force(texts):
    """One tuple for each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    alphabet = byte_alphabet()
    docs = []
    for t in texts:
        ids_a, ids_b = (A.encode(" " + t, add_special_tokens=False).ids, B.encode(t)) if t else ([], [])
        bytes_a = [bytes(alphabet[c] for c in A.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i)
                   else B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if t and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            ids_a = ids_b = bytes_a = bytes_b = []
        ends = [[sum(map(len, side[:0]))] for side in (bytes_a, bytes_b)]
        for e, side in zip(ends, (bytes_a, bytes_b)):
            for x in side:
                e.append(e[-1] + len(x))
        common = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups, low = [], 0
        at = [{e: k for k, e in enumerate(es)} for es in ends]
        for high in common:
            groups.append((ids_a[at[0][low]:at[0][high]], ids_b[at[1][low]:at[1][high]]))
            low = high
        docs.append((len(ids_a), len(ids_b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(p for d in docs for p in d[3])
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(k for p, k in links.items() if count[p] == top[p[0]]),
                    sum(k * count[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_whole_table(spark, med_docs):
    got = {r.doc_id: tuple(r[c] for c in (*COLUMNS, "groups_sha256"))
           for r in op13_tokenizer_alignment(spark, "/root/testdata/sf0.01").collect()}
    assert got == dict(zip((d for d, _ in med_docs), brute_force([t for _, t in med_docs])))


@pytest.mark.parametrize("table_pairs", [0, 20, 10 ** 6])
def test_odd_texts(spark, table_pairs):
    data = [(k // 3 if k else None, t, "x") for k, t in enumerate(ODD)] + [(5, "same row", "y")] * 30
    df = spark.createDataFrame(data, "doc_id int, text string, pairs string").repartition(3)
    got = alignment.linked(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                           public_tokenizers.path("piece_bpe_32k.model"), digest=True, table_pairs=table_pairs).collect()
    want = [(d, *w) for (d, _, _), w in zip(data, brute_force([t for _, t, _ in data]))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, *(r[c] for c in COLUMNS), r.groups) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.n_a == 0 for r in got) == 3            # null, empty, and the one that holds B's space mark


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.linked(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                            public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_run_skipping_finds_all_common_ends():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 400)
        dense = rng.random()
        a, b = (sorted({n, *(x for x in range(1, n) if rng.random() < dense)}) for _ in range(2))
        if rng.random() < 0.5:                              # long one-to-one stretches
            b = sorted({n, *(x for x in a if rng.random() < 0.97)})
        common = sorted(set(a) & set(b))
        assert aligned_ends(a, b) == (common, common)


def aligned_ends(a, b):
    to_a, to_b = alignment.aligned(a, b)
    return [a[i - 1] for i in to_a], [b[j - 1] for j in to_b]


def new_aligner():
    return alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                             public_tokenizers.path("piece_bpe_32k.model"))


def test_known_chunks_cost_no_python_call(med_docs):
    """Work in Python goes by block and document, not by chunk or token."""
    texts, worker = [t or "" for _, t in med_docs[:300]], new_aligner()
    first = list(worker.documents(texts))
    profile = cProfile.Profile()
    again = profile.runcall(lambda: list(worker.documents(texts)))
    calls = sum(x.callcount for x in profile.getstats())
    assert calls < 0.2 * sum(len(t.split(" ")) for t in texts)
    assert [x[:5] for x in again] == [x[:5] for x in first]


def test_forgotten_chunks_are_learned_again(med_docs):
    texts = [t or "" for _, t in med_docs[:200]] + ODD[5:]
    worker, small = new_aligner(), new_aligner()
    small.BLOCK, small.memory.size = 5000, 50
    plain = lambda rows: [(*r[:5], list(r[5]), list(r[6])) for r in rows]
    assert plain(small.documents(texts)) == plain(worker.documents(texts))
    assert len(small.memory.row) < len(worker.memory.row)


def test_links_of_large_groups_are_counted_not_listed():
    worker = new_aligner()
    worker.LISTED = 3
    got = worker._pairs(np.array([7, 7, 8, 9]), np.array([1, 2, 2, 3]), np.array([3, 4]), np.array([3, 4]))
    width = worker.b.n_ids
    pairs = dict(zip(got[1].tolist(), got[2].tolist()))
    assert got[0].tolist() == [4, 1]
    assert pairs == {7 * width + 1: 2, 7 * width + 2: 4, 8 * width + 1: 1, 8 * width + 2: 2, 9 * width + 3: 1}
