"""Exact top-k, vector codes and cross-tokenizer alignment against brute force; hashes of long patterns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplylens.llm import codes, crosstokens, decontaminate, near, packing, substrings, topk
from supplylens.llm import textarrays as T

VECTORS = "vec_id long, embedding array<double>, label int, row long, v string, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    hot = [rng.uniform(-1, 1) for _ in range(16)]
    rows = []
    for i in range(400):
        e = hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(16)]
        rows.append((i, e, i % 4 or None))
    rows += [(401, None, 1), (402, [1.0, None] * 8, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] * 16, 2), (405, [0.0] * 16, 2),
             (40, rows[41][1], 3), (40, rows[40][1], 3), (None, rows[42][1], None), (406, [], 1), (407, [0.5, -0.5], 1), (420, [3.0, 1.0], 1)]
    return spark.createDataFrame([(*r, 7, "x", 0.5) for r in rows], VECTORS)


def _valid(df):
    return [r for r in df.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]


def _top(rows, k, scale=64):
    ints = [[int(np.floor(scale * x)) for x in r.embedding] for r in rows]
    out = []
    for i, q in enumerate(rows):
        if q.vec_id is None or q.vec_id % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(ints[i], ints[j])), c.vec_id is None, c.vec_id or 0, c.vec_id) for j, c in enumerate(rows)
                  if j != i and len(ints[j]) == len(ints[i])]
        out += [(q.vec_id, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k,block", [(20, 64), (3, 4096)])
def test_top_k_against_brute_force(spark, vectors, k, block):
    got = topk.exact_top_k(spark, vectors, k=k, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == _top(_valid(vectors), k)


def test_top_k_of_few_large_and_no_vectors(spark, vectors):
    few = vectors.where("vec_id in (0, 1, 2, 20)")
    assert Counter(tuple(r) for r in topk.exact_top_k(spark, few).collect()) == _top(_valid(few), 20)
    assert topk.exact_top_k(spark, vectors.limit(0)).collect() == []
    assert topk.exact_top_k(spark, vectors.where("vec_id = 1")).collect() == []
    # whole numbers beyond what doubles hold exactly
    big = spark.createDataFrame([(i, [1e5 * (i + 1) + 1, 3e5 - i, 1e7 + i], 0, 0, "", 0.0) for i in range(40)], VECTORS)
    assert Counter(tuple(r) for r in topk.exact_top_k(spark, big, k=5).collect()) == _top(_valid(big), 5)
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i], 0, 0, "", 0.0) for i in range(22)], VECTORS)
    assert {r.score for r in topk.exact_top_k(spark, huge, k=30).collect()} == {2**61, -2**61}


def _coded(rows, parts=8, k=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id or 0, np.floor(4096 * np.array(r.embedding)).astype(np.int64).tobytes()))
    x = np.array([[int(np.floor(4096 * c)) for c in r.embedding] for r in rows], object)
    width = x.shape[1] // parts
    books, final = [], []
    for p in range(parts):
        own = x[:, p * width:(p + 1) * width]
        book = [list(v) for v in own[:k]]
        for turn in range(rounds + 1):
            d = [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in book] for v in own]
            near_ = [min(range(len(book)), key=lambda e: (row[e], e)) for row in d]
            if turn < rounds:
                for e in range(len(book)):
                    mine = [v for v, n in zip(own, near_) if n == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        books.append(book)
        final.append([(n, row[n]) for n, row in zip(near_, d)])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(r.vec_id, "".join(f"{final[p][i][0]:02x}" for p in range(parts)), sum(final[p][i][1] for p in range(parts)), r.label) for i, r in enumerate(rows)]
    sums = defaultdict(int)
    for _, _, error, label in out:
        sums[label] += error
    return Counter((v, c, e, sums[label]) for v, c, e, label in out), digest


def test_vector_codes_against_brute_force(spark, vectors):
    coded, books = codes.compressed_vectors(spark, vectors.repartition(5))
    got = codes.label_errors(spark, coded).select("vec_id", "code", "error", "label_error")
    want, digest = _coded([r for r in _valid(vectors) if len(r.embedding) == 16])
    assert Counter(tuple(r) for r in got.collect()) == want and books.digest() == digest


def test_vector_codes_of_few_large_odd_and_no_vectors(spark, vectors):
    few = vectors.where("vec_id in (1, 2, 4, 5)")
    coded, books = codes.compressed_vectors(spark, few)
    want, digest = _coded(_valid(few))
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {k[0]: (k[1], 0) for k in want} and books.digest() == digest
    coded, books = codes.compressed_vectors(spark, vectors.limit(0).drop("label"))
    assert codes.label_errors(spark, coded).collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    huge = spark.createDataFrame([(i, [1e300 * i, 1.0, -1e300], 0, 0, "", 0.0) for i in range(20)], VECTORS)
    assert codes.compressed_vectors(spark, huge)[0].count() == 20
    wide = spark.createDataFrame([(i, [float(10 ** (i % 9))] * 8, 0, 0, "", 0.0) for i in range(40)], VECTORS)
    want, digest = _coded(_valid(wide))
    coded, books = codes.compressed_vectors(spark, wide)
    assert Counter((r.vec_id, r.code, r.error) for r in coded.collect()) == Counter(k[:3] for k in want.elements()) and books.digest() == digest


TEXTS = [None, "", " ", "  ", "a ", "a  b", " a", "\n", "a\n b", "x▁y", "▁", "<|endoftext|> <s> </s>", "a\x00b", "é è É", "ﬁ ① Å", "z" * 5000,
         "日本語 テキスト", "it's  they'll\t x ", "a b " * 3000, "  b", "à b", "🎉🎉 x", "The well-known tokenization, of unbelievable words; internationalization."]


def _aligned(texts):
    """Ids, groups and links by the definition, whole texts at a time."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = {}
    extra = 0
    for byte in range(256):
        own = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        table[chr(byte if own else 256 + extra)] = byte
        extra += not own
    found, counts = {}, Counter()
    for k, text in enumerate(texts):
        found[k] = None
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        parts = ([bytes(table[c] for c in a.id_to_token(i)) for i in ids[0]],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            continue
        owner = [[j for j, x in enumerate(p) for _ in x] for p in parts]
        links = sorted({(i, j) for i, j in zip(*owner)})
        ends = [set(np.cumsum([len(x) for x in p]).tolist()) for p in parts]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i in (x[j] for j in sorted(set(o[at:end])))) for x, o in zip(ids, owner)))
            at = end
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        counts.update(pairs)
        found[k] = (len(ids[0]), len(ids[1]), groups, pairs)
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return {k: (0, 0, 0, 0, 0, 0, "", "") if f is None else (
        f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == top[p[1]] for p in f[3]), sum(counts[p] for p in f[3]),
        hashlib.sha256(";".join(f[2]).encode()).hexdigest(), ";".join(f[2])) for k, f in found.items()}


def test_alignment_against_brute_force(spark):
    texts = [*TEXTS, TEXTS[-1], TEXTS[-1] + " " + TEXTS[5]]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, chunk int").repartition(3)
    got = crosstokens.aligned_documents(spark, docs, with_groups=True)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == _aligned(texts)
    assert crosstokens.aligned_documents(spark, docs.limit(0)).collect() == []


def test_alignment_of_one_long_text(spark):
    text = "long texts, " * 200_000
    row = crosstokens.aligned_documents(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    one = crosstokens.aligned_documents(spark, spark.createDataFrame([(1, "long texts, long texts, ")], "doc_id long, text string")).first()
    two = crosstokens.aligned_documents(spark, spark.createDataFrame([(1, "long texts, " * 3)], "doc_id long, text string")).first()
    assert row.n_a == one.n_a + (two.n_a - one.n_a) * (200_000 - 2) and row.n_links == one.n_links + (two.n_links - one.n_links) * (200_000 - 2)


def test_groups_are_slices_between_common_ends():
    a, b = [2, 3, 5, 9], [1, 3, 7, 9]
    to_a, to_b = crosstokens.common_slices(a, b)
    assert to_a.tolist() == [2, 4] and to_b.tolist() == [2, 4]
    i, j = crosstokens.slice_links(np.array(a), np.array(b), to_a, to_b)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)]


def _pattern(n):
    """Two words whose difference cancels in a polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_patterns_that_cancel_are_two_texts(spark):
    first, second = _pattern(2048)
    spans = [T.of_bytes(np.frombuffer(w.encode(), np.uint8)).spans(np.array([0]), np.array([2048]))[0] for w in (first, second)]
    assert spans[0] != spans[1]
    lead = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, first), (2, second), (3, f"{lead} {first}"), (4, f"{lead} {second}")], "doc_id long, text string")
    assert all(r.kept for r in near.near_duplicates(spark, docs.where("doc_id < 3"), width=4).collect())
    assert all(r.n_removed == 0 for r in substrings.repeated_passages(spark, docs).collect())
    items = spark.createDataFrame([(1, first)], "item_id long, text string")
    hits = {r.doc_id: r.contaminated for r in decontaminate.contamination(spark, docs, items).collect()}
    assert hits == {1: True, 2: False, 3: True, 4: False}
    crcs = {r.doc_id: r.ids_crc32 for r in packing.packed_sequences(spark, docs.where("doc_id < 3")).collect()}
    assert crcs[1] != crcs[2]


@pytest.mark.parametrize("block_bytes", [4 << 20, 60])
def test_clean_rows_are_judged_by_their_own_text(spark, block_bytes):
    bad, good = "one two three four five six seven eight nine ten eleven", "nothing of that kind is written here"
    docs = spark.createDataFrame([(1, bad, [1], "a"), (1, good, None, "b"), (None, bad, None, "c"), (None, good, [2], "d"), (2, None, None, "e"), (3, "", None, "f")],
                                 "doc_id long, text string, items array<long>, hits string")
    items = spark.createDataFrame([(1, bad), (2, "other words of a second item, long enough for a window of ten"), (3, None)], "item_id long, text string")
    kept = decontaminate.without_contaminated(spark, docs, items, block_bytes=block_bytes)
    assert kept.schema == docs.schema and sorted(r.hits for r in kept.collect()) == ["b", "d", "e", "f"]
    verdicts = decontaminate.contamination(spark, docs, items, block_bytes=block_bytes)
    assert sum(r.contaminated for r in verdicts.collect()) == 2
