"""Alignment against whole texts encoded by themselves, every pair of tokens tried."""

import hashlib
import random
from collections import Counter

import pytest

from tallyspark.llm import token_alignment
from tallyspark.llm.queries import QUERIES, vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
#: What tokenizers treat apart: white space of many kinds, marks, bytes outside both
#: vocabularies, names of special tokens, and the letter that stands for a blank.
ODD = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r", "\r\n", "a", "foo", "Bar", "'s", "don't", "123",
       "4", "é", "漢字", "😀", "<s>", "</s>", "<|endoftext|>", "▁", " ", "​", "᠎", "\x1c",
       "\x85", "　", ";", "{", "}", "\x00", "ﬁ", "Å", "а", "//", "-", "<0x0A>"]


@pytest.fixture(scope="module")
def vocab():
    return token_alignment.Tokenizers(*PATHS)


def ranges(ids, names):
    at, out = 0, []
    for k in ids:
        out.append((at, at + len(names[k]), k))
        at += len(names[k])
    return out


def plain(vocab, text):
    """(n_a, n_b, groups as text, links) by the definition."""
    raw = (" " + (text or "")).encode()
    a = vocab.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = vocab.b.encode(text or "")
    if not text or any(b"".join(n[k] for k in ids) != raw
                       for ids, n in ((a, vocab.bytes_a), (b, vocab.bytes_b))):
        return 0, 0, "", []
    left, right = ranges(a, vocab.bytes_a), ranges(b, vocab.bytes_b)
    cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
    groups = ["|".join(",".join(str(k) for s, _, k in side if low <= s < high)
                       for side in (left, right))
              for low, high in zip([0, *cuts], cuts)]
    links = [(x, y) for s, e, x in left for t, f, y in right if s < f and t < e]
    return len(a), len(b), ";".join(groups), links


def digest(groups):
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def test_stretches_are_exact(vocab):
    assert vocab.separable
    rng = random.Random(8)
    texts = ["".join(rng.choices(ODD, k=rng.randint(1, 14))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a", "x" * 300, "ab " * 200]
    assert all("".join(token_alignment.stretches(x, vocab)) == " " + x for x in texts if x)
    work = token_alignment._measure(*PATHS)
    empty = 0
    for _ in range(2):  # the second time from memory
        for k in range(0, len(texts), 500):
            some = texts[k:k + 500]
            (got,) = work(some, some)
            for text, n_a, n_b, n, m, sha, pairs, times in zip(*got):
                a, b, groups, links = plain(vocab, text)
                assert (n_a, n_b, n, m, sha) == (
                    a, b, groups.count(";") + bool(groups), len(links), digest(groups)), text
                if links:
                    ids, many = token_alignment._unpacked(
                        pairs, times, token_alignment.link_kind(50257, 32000))
                    size = len(vocab.bytes_b)
                    assert {(int(p) // size, int(p) % size): int(t)
                            for p, t in zip(ids, many)} == Counter(links)
                empty += not a
    assert empty > 100


def whole(vocab, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    rows = [plain(vocab, t) for t in texts]
    counts = Counter(x for *_, links in rows for x in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(a, b, g.count(";") + bool(g), len(links), sum(counts[x] == top[x[1]] for x in links),
             sum(counts[x] for x in links), digest(g)) for a, b, g, links in rows]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_id(rows):
    return sorted(((r["doc_id"], *(r[n] for n in NAMES)) for r in rows), key=str)


@pytest.mark.parametrize("common", [0, 30, 500_000])
def test_counts_over_the_corpus(spark, folder, vocab, common):
    """Whichever pairs are sent to the workers and whichever are joined, with the same result."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 1200")
    rows = docs.select("doc_id", "text").collect()
    want = whole(vocab, [r["text"] for r in rows])
    got = token_alignment.align_documents(docs, *PATHS, common_pairs=common).collect()
    assert len(rows) > 40
    assert by_id(got) == sorted(((r["doc_id"], *w) for r, w in zip(rows, want)), key=str)


def test_odd_rows(odd, vocab):
    rows = odd.where("doc_id is null or doc_id <> 5").select("doc_id", "text").collect()
    got = token_alignment.align_documents(odd.where("doc_id is null or doc_id <> 5"), *PATHS)
    want = whole(vocab, [r["text"] for r in rows])
    assert by_id(got.collect()) == sorted(
        ((r["doc_id"], *w) for r, w in zip(rows, want)), key=str)
    long_one = token_alignment.align_documents(odd.where("doc_id = 5"), *PATHS).first()
    assert long_one["n_groups"] > 30_000
    assert token_alignment.align_documents(odd.where("false"), *PATHS).collect() == []


def test_query(spark, folder):
    frame = QUERIES["op12_token_alignment"](spark, folder)
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                             "n_best", "count_sum"]
    assert dict(frame.dtypes)["n_best"] == dict(frame.dtypes)["count_sum"] == "bigint"
    assert frame.count() == 200
