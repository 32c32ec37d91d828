import base64
import random
from pathlib import Path

import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import bpe

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def reference():
    lines = Path(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(spark):
    rng = random.Random(2)
    odd = ["", " ", "\n\n  x", None, "naïve café", "<|endoftext|>", "\ue000a\ue002b\ue001", "\x00\x85 a  b", "日本語のテキスト", "🙂🙃 zeta", "a" * 5000, "=" * 3000, "It's we'll I'D", "١٢٣ ½ ②", "x\u00a0y\u2003z"]
    letters = "abc XYZ019 \n\t'.,é😀ß\u3000Ω\u0301-_"
    texts = odd + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["the Werdrouthis " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, ""), (None, "null key")], "doc_id long, text string").withColumn("codes", F.lit(1)).withColumn("_row", F.lit(1))
    rows = bpe.encode(docs).select("doc_id", bpe.ids(F.col("codes")).alias("ids")).withColumn("back", bpe.decode(F.col("ids"))).collect()
    assert len(rows) == len(texts) + 2
    enc = reference()
    for r in rows:
        text = "null key" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(text), text[:50]
        assert r.back == text


def test_words_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FREQUENT", 1)
    docs = spark.createDataFrame([(1, "Werdrouthis Teloux"), (2, "Teloux Teloux"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs).select("doc_id", bpe.ids(F.col("codes")).alias("ids")).collect()}
    enc = reference()
    assert got == {1: enc.encode_ordinary("Werdrouthis Teloux"), 2: enc.encode_ordinary("Teloux Teloux"), 3: []}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_long_words(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (127, 128, 129, 1000, 100_000)] + ["".join(rng.choice("0123456789") for _ in range(50_000)), "ab" * 30_000, "é" * 5000, "x" + "-" * 9999]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = reference()
    for r in bpe.encode(docs).select("doc_id", bpe.ids(F.col("codes")).alias("ids")).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]), texts[r.doc_id][:20]
    v = bpe.vocabulary(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    ranks = dict(v.merges)
    for word in ["a", "ab", "aaaa", "Werdrouthis" * 3] + ["".join(rng.choice("abc") for _ in range(60)) for _ in range(200)]:
        slow = word
        while any(p in ranks for p in map("".join, zip(slow, slow[1:]))):
            best = min(p for p in map("".join, zip(slow, slow[1:])) if p in ranks and ranks[p] == min(ranks[q] for q in map("".join, zip(slow, slow[1:])) if q in ranks))
            slow = slow.replace(best, ranks[best])
        assert bpe.merge_long(word, ranks) == slow
