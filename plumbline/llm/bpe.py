"""Byte-level BPE as Spark expressions: a fold of ranked merges over the bytes of distinct words.

The fold looks at all neighbours before each merge, so its time grows with the square of a word's length. Words of more than
LONG bytes, such as an encoded file without blanks, are merged with a heap in Arrow batches instead; both give the same tokens.

A token is written as one character: a single byte b as U+00b, a merged token as the character whose
code point is its id (256 and up, below the surrogates). A merge of all occurrences of a pair, from
left to right, is then a plain string replacement, the rank of a merge is the order of its character,
and an encoded text is a string with one character per token.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, keep, map_arrow

TOKENIZERS = "/opt/tokenizers"
#: The public tokenizer's way to cut a text into words, with Unicode white space spelled out for Java.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Private-use characters that no token is written with: before an entry or unknown word, after it, after a key.
OPEN, CLOSE, KEY = "\uE000", "\uE001", "\uE002"
BUCKETS = 1 << 14
#: So many of the most frequent words that aren't one token are looked up in a literal table too.
FREQUENT = 1 << 14
#: Bytes of a word that the fold takes on.
LONG = 128


def byte_letters() -> list[str]:
    """The letter that the vocabulary file writes each byte as: printable ones as themselves, the rest from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: ids of bytes, merges, and the words that are one token."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [model["vocab"][c] for c in letters]
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in model["vocab"].items()}
        top = max(self.token_bytes)
        if top >= 0xD800 or sorted(self.byte_ids) != list(range(256)):
            raise ValueError("this vocabulary doesn't fit one character per token")
        char = lambda t: chr(to_byte[t]) if len(t) == 1 else chr(model["vocab"][t])
        self.merges: list[tuple[str, str]] = []  # (pair, merged), by rank
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((char(a) + char(b), char(a + b)))
        if [ord(c) for _, c in self.merges] != list(range(256, 256 + len(self.merges))):
            raise ValueError("ids of merged tokens must follow the merges")
        self.words: list[tuple[str, str]] = []
        for i, raw in self.token_bytes.items():
            try:
                self.words.append((raw.decode("utf-8"), chr(raw[0]) if len(raw) == 1 else chr(i)))
            except UnicodeDecodeError:
                continue

    @staticmethod
    def maps(entries: list[tuple[str, str]]) -> Column:
        """Entries by hash bucket, as an array of small maps that Spark folds into a literal."""
        buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
        for key, value in entries:
            buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS][key] = value
        return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")

    @staticmethod
    def table(entries: list[tuple[str, str]]) -> str:
        """Entries by hash bucket, as one text that Spark splits into an array once."""
        buckets = [""] * BUCKETS
        for key, value in entries:
            buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS] += OPEN + key + KEY + value
        return CLOSE.join(buckets)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _find(table: Column, key: Column) -> Column:
    """The character of ``key`` in a bucket table, or an empty string."""
    bucket = F.get(table, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.left(F.split_part(bucket, F.concat(F.lit(OPEN), key, F.lit(KEY)), F.lit(2)), F.lit(1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merge_all(word: Column, v: Vocabulary) -> Column:
    """The fold: while some neighbours have a rank, replace the pair of the lowest."""
    pairs = F.split(F.lit(Vocabulary.table(v.merges)), CLOSE)
    pair_of = F.split(F.lit(CLOSE.join(p for p, _ in v.merges)), CLOSE)

    def lowest(s: Column) -> Column:
        return _let(F.split(s, ""), lambda a: F.array_min(F.filter(F.transform(a, lambda c, i: F.when(i + 1 < F.size(a), _find(pairs, F.concat(c, F.get(a, i + 1))))), lambda m: m != "")))

    def step(state: Column, _: Column) -> Column:
        s = state["s"]
        merged = _let(lowest(s), lambda m: F.struct(F.when(m.isNull(), s).otherwise(F.replace(s, F.get(pair_of, F.ascii(m) - 256), m)).alias("s"), m.isNotNull().alias("go")))
        return F.when(state["go"], merged).otherwise(state)

    start = F.struct(word.alias("s"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)["s"]


def merge_long(word: str, ranks: dict[str, str]) -> str:
    """The merges of the fold in n log n steps: a heap of mergeable neighbours, the lowest rank first, then the leftmost.

    A merged token is newer than its parts, so no merge makes a pair of a lower rank.
    """
    at, after, before = list(word), [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
    heap = [(m, i, a + b) for i, (a, b) in enumerate(zip(word, word[1:])) if (m := ranks.get(a + b))]
    heapq.heapify(heap)
    while heap:
        merged, i, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or not at[i] or at[i] + at[j] != pair:
            continue
        at[i], at[j] = merged, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (m := ranks.get(at[left] + at[after[left]])):
                heapq.heappush(heap, (m, left, at[left] + at[after[left]]))
    return "".join(at)


def _long_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = dict(vocabulary(path).merges)
        for b in batches:
            codes = pa.array([merge_long(w, ranks) for w in b["_bytes"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["_word"], b["_n"], codes], names=["_word", "_n", "_code"])

    return run


def _look(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.get(maps, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


def _bytes_of(word: Column) -> Column:
    """The bytes of a word as characters."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _marked(word: Column, odd: bool) -> Column:
    """A word that isn't encoded yet. In an odd text, which holds the marks themselves, its bytes stand for it."""
    return F.concat(F.lit(OPEN + KEY), _bytes_of(word), F.lit(CLOSE)) if odd else F.concat(F.lit(OPEN), word, F.lit(CLOSE))


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as (``key``, codes): a string with one character per token of byte_bpe_50k.

    Null and empty texts give an empty string. Every row gives one row, repeated ones included; other
    columns don't come out. Special tokens in a text are ordinary text.

    Words that are one token are looked up in a literal table, which is as large as the vocabulary.
    Only the distinct other words are folded, each once; they grow far slower than the texts. Of those the
    FREQUENT most frequent ones, counted over all documents, are looked up in a literal table as well. The
    rest, which no longer has hot words, is joined by shuffle, at every size the same way.
    """
    v = vocabulary(f"{tokenizers}/byte_bpe_50k.json")
    single = Vocabulary.maps(v.words)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))
    odd = F.coalesce(F.col(text).rlike(f"[{OPEN}{CLOSE}{KEY}]"), F.lit(False))
    tokens = F.when(odd, F.transform(words, lambda w: F.coalesce(_look(single, w), _marked(w, True)))).otherwise(F.transform(words, lambda w: F.coalesce(_look(single, w), _marked(w, False))))
    drafts = keep(documents.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.array_join(tokens, "").alias("_draft")))

    pieces = F.split("_draft", OPEN)
    unknown = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.substring_index(p, CLOSE, 1))
    counted = drafts.select(F.explode(unknown).alias("_word")).groupBy("_word").agg(F.count("*").alias("_n"))
    spelled = F.when(F.startswith("_word", F.lit(KEY)), F.substr("_word", F.lit(2))).otherwise(_bytes_of(F.col("_word")))
    spelled_out = cut(counted.select("_word", "_n", spelled.alias("_bytes")))
    is_long = F.length("_bytes") > LONG
    long_words = map_arrow(spelled_out.where(is_long), _long_words(f"{tokenizers}/byte_bpe_50k.json"), "_word string, _n bigint, _code string")
    folded = cut(spelled_out.where(~is_long).select("_word", "_n", _merge_all(F.col("_bytes"), v).alias("_code")).unionByName(long_words))
    frequent = Vocabulary.maps([(r["_word"], r["_code"]) for r in folded.orderBy(F.desc("_n"), "_word").limit(FREQUENT).collect()])

    def known(p: Column) -> Column:
        return F.coalesce(F.concat(_look(frequent, F.substring_index(p, CLOSE, 1)), F.substring_index(p, CLOSE, -1)), F.concat(F.lit(OPEN), p))

    half = drafts.select("_row", "_key", F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(known(p))), "").alias("_draft"))
    dictionary = folded.select("_word", "_code").hint("merge")
    cut_up = half.select("_row", "_key", F.posexplode(pieces).alias("_pos", "_piece"))
    nobody = F.concat(F.lit(KEY + KEY), F.col("_row").cast("string"))  # a text's first piece has no word; a null would send all of them to one task
    cut_up = cut_up.select("_row", "_key", "_pos", F.when(F.col("_pos") > 0, F.substring_index("_piece", CLOSE, 1)).otherwise(nobody).alias("_word"), F.substring_index("_piece", CLOSE, -1).alias("_rest"))
    coded = cut_up.join(dictionary, "_word", "left").select("_row", "_key", F.struct("_pos", F.concat(F.coalesce("_code", F.lit("")), "_rest").alias("s")).alias("_p"))
    whole = coded.groupBy("_row", "_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["s"]), "").alias("codes"))
    return whole.select(F.col("_key").alias(key), "codes")


def ids(codes: Column, tokenizers: str = TOKENIZERS) -> Column:
    """The token ids of an encoded text."""
    v = vocabulary(f"{tokenizers}/byte_bpe_50k.json")
    of = F.split(F.lit(",".join(map(str, [*v.byte_ids, *range(256, 256 + len(v.merges))]))), ",").cast("array<int>")
    return F.when(codes == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(codes, ""), lambda c: F.get(of, F.ascii(c))))


def decode(token_ids: Column, tokenizers: str = TOKENIZERS) -> Column:
    """The text of token ids: their binary pieces joined and read as UTF-8; null ids give null."""
    v = vocabulary(f"{tokenizers}/byte_bpe_50k.json")
    hexed = F.split(F.lit(",".join(v.token_bytes.get(i, b"").hex() for i in range(max(v.token_bytes) + 1))), ",")
    return F.decode(F.unhex(F.array_join(F.transform(token_ids, lambda i: F.get(hexed, i)), "")), "UTF-8")
