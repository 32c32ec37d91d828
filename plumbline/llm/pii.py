"""Personal items in texts: a linear-chain conditional random field over word shapes, decoded by Viterbi."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pii_table import labelled
from plumbline.session import map_arrow

KINDS = ["name", "email", "phone", "idnum", "address"]
LABELS = 1 + 2 * len(KINDS)  # outside; first and further token of each kind
TOKEN = re.compile(r"(\+?[\w*█'’]+(?:[-./+][\w*█'’]+)*(?:@[^\s<>()\[\],;:\"&]*[\w*])?|[^\w\s])")
#: Share of the words that training hides, strength of the penalty, and how often the table must show a key to make it known.
FORGET, PENALTY, FEW = 0.15, 1e-5, 10
#: What the score of a name gains where the same text shows the word as part of one elsewhere, and what one gains anywhere.
AGAIN, LEAN = 4.0, 0.5
#: Tokens whose words a token's label is judged by, beside its own.
WINDOW = 3
CLASSES = ["pad", "X", "X.X", "9", "9.9", "x9", "@", "*", ".", ",", "(", ")", "[", "]", ";", ":", "—", "&", "?", "<", ">", "/", "-", "'", "’"]
#: How well public vocabularies know a word: 0 to 2 by the letters of its pieces, 3 as a word, 4 with a capital only.
KNOWN = 5
CLASSES += [f"{c}{k}" for c in ("Xx", "XX", "X-X", "x") for k in range(KNOWN)]
TOKENIZERS = "/opt/tokenizers"
GLUE = 4  # 1: no white space before the token; 2: a line break before it


def shape(token: str) -> str:
    """Letters as X and x in runs of one, digits one by one (0 where a number begins with it), the rest as it is."""
    s = re.sub(r"[0-9]+", lambda m: ("0" if m[0][0] == "0" else "9") + "9" * min(9, len(m[0]) - 1), token)
    s = re.sub(r"[^\W\d_]+", lambda m: "".join(dict.fromkeys("X" if c.isupper() else "x" for c in m[0])) if len(m[0]) > 1 else ("X" if m[0].isupper() else "x"), s)
    return s


class Vocabulary:
    """How well the public vocabularies know a word. Names are rarely words of a vocabulary, or only with a capital."""

    def __init__(self, tokenizers: str) -> None:
        self.pieces: set[bytes] = set()
        for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
            self.pieces |= {base64.b64decode(x.split()[0]) for x in Path(tokenizers, f"{name}.tiktoken").read_bytes().splitlines() if x}

    def known(self, word: str) -> int:
        low = word.lower()
        if f" {low}".encode() in self.pieces:
            return 3
        if f" {low.capitalize()}".encode() in self.pieces:
            return 4
        raw, n, at = f" {low}".encode(), 0, 0
        while at < len(raw):  # the longest piece, then the longest piece of the rest
            end = min(len(raw), at + 24)
            while end > at + 1 and raw[at:end] not in self.pieces:
                end -= 1
            at, n = end, n + 1
        return min(2, max(0, len(word) // n - 2))


def coarse(token: str, vocabulary: Vocabulary) -> str:
    if "*" in token or "█" in token:
        return "*"
    if "@" in token and len(token) > 1:
        return "@"
    if len(token) == 1 and not token.isalnum():
        return token if token in CLASSES else "?"
    digit, letter = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
    if digit:
        return "x9" if letter else "9" if token.isdigit() else "9.9"
    if not letter:
        return "?"
    if "." in token and token.upper() == token:
        return "X.X"
    if token[0].isupper() and len(token) == 1:
        return "X"
    kind = "X-X" if "-" in token and any(c.isupper() for c in token) else "x" if not token[0].isupper() else "XX" if token.upper() == token else "Xx"
    return f"{kind}{vocabulary.known(POSSESSIVE.sub("", token))}"


def rough(token: str) -> str:
    """The shape of a token that isn't a word, runs of digits as one."""
    return re.sub(r"9+|09*", "9", shape(token)) + "~"


class Reader:
    """Tokens as numbers: known words with their case, known shapes, else rough shapes; their ending; and a coarse class.

    ``counts`` are the keys of the labelled table; those seen less than FEW times aren't known.
    """

    def __init__(self, counts: dict[str, int], endings: dict[str, int], vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.keys = {"": 0} | {k: i + 1 for i, k in enumerate(sorted(k for k, n in counts.items() if n >= FEW))}
        self.endings = {"": 0} | {e: i + 1 for i, e in enumerate(sorted(e for e, n in endings.items() if e and n >= FEW))}

    @staticmethod
    def word(token: str) -> str:
        return f"{token.lower()}|{'U' if token.isupper() else 'C' if token[:1].isupper() else ''}"

    @staticmethod
    def choices(token: str) -> list[str]:
        """Keys of a token, the most telling first."""
        if token.isalpha():
            return [Reader.word(token), f"{token.lower()}|"]
        return [Reader.word(token), shape(token), rough(token)]

    def key(self, token: str) -> int:
        return next((self.keys[k] for k in self.choices(token) if k in self.keys), 0)

    def hidden(self, token: str) -> int:
        """The key of a token as if the table didn't know it."""
        return 0 if token.isalpha() else self.keys.get(rough(token), 0)

    def ending(self, token: str) -> int:
        return self.endings.get(ending(token), 0)

    def coarse(self, token: str) -> int:
        return CLASSES.index(coarse(token, self.vocabulary))


def ending(token: str) -> str:
    return token[-3:].lower() if len(token) > 4 and token[-3:].isalpha() else ""


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Tokens and what stands around them: one more string than tokens."""
    parts = TOKEN.split(text)
    return parts[1::2], parts[0::2]


def begins(toks: list[str], gaps: list[str]) -> np.ndarray:
    """Where each token begins."""
    lengths = np.array(list(map(len, toks)), np.int64)
    return np.cumsum(np.array(list(map(len, gaps[: len(toks)])), np.int64)) + np.cumsum(lengths) - lengths


def glue_of(gap: str) -> int:
    return 1 if not gap else 2 if "\n" in gap else 0


class Model:
    """Weights of the field: per window place of known keys, of classes and of endings, of glue, of two neighbouring classes, and of label pairs."""

    def __init__(self, reader: Reader, key_w: np.ndarray, class_w: np.ndarray, ending_w: np.ndarray, glue_w: np.ndarray, two_w: np.ndarray, pair_w: np.ndarray) -> None:
        self.reader, self.key_w, self.class_w, self.ending_w, self.glue_w, self.two_w, self.pair_w = reader, key_w, class_w, ending_w, glue_w, two_w, pair_w


ALLOWED = np.zeros((LABELS + 1, LABELS), bool)  # the last row: at the start
ALLOWED[:, [0, *range(1, LABELS, 2)]] = True
for _k in range(len(KINDS)):
    ALLOWED[1 + 2 * _k, 2 + 2 * _k] = ALLOWED[2 + 2 * _k, 2 + 2 * _k] = True
NEVER = -1e4


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _grouped(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the sum of the rows of each)."""
    order = np.argsort(ids, kind="stable")
    held, starts = np.unique(ids[order], return_index=True)
    return held, np.add.reduceat(rows[order], starts, axis=0)


def train(rounds: int = 30, epochs: int = 6, seed: int = 0, tokenizers: str = TOKENIZERS) -> Model:
    """The field fitted to the labelled table: maximum likelihood with a small penalty, by Adam over padded batches."""
    counts: dict[str, int] = {}
    ends: dict[str, int] = {}
    read = []
    for text, spans in labelled(rounds):
        toks, gaps = tokens(text)
        begin, glue = begins(toks, gaps), np.array([glue_of(g) for g in gaps[:-1]], np.int64)
        label = np.zeros(len(toks), np.int64)
        for s, e, kind in spans:
            inside = np.flatnonzero((begin >= s) & (begin < e))
            label[inside] = 2 + 2 * KINDS.index(kind)
            if len(inside):
                label[inside[0]] -= 1
        read.append((toks, glue, label))
        for t in toks:
            for k in {*Reader.choices(t)}:
                counts[k] = counts.get(k, 0) + 1
            ends[ending(t)] = ends.get(ending(t), 0) + 1
    reader = Reader(counts, ends, Vocabulary(tokenizers))
    seen: dict[str, tuple[int, int, int, int]] = {}
    sequences = []
    for toks, glue, label in read:
        if toks:
            seen |= {t: (reader.key(t), reader.hidden(t), reader.coarse(t), reader.ending(t)) for t in toks if t not in seen}
            sequences.append((np.array([seen[t] for t in toks]).T, glue, label))
    rng = np.random.default_rng(seed)
    places = 2 * WINDOW + 1
    shapes = [(places, len(reader.keys), LABELS), (places, len(CLASSES), LABELS), (places, len(reader.endings), LABELS), (2, GLUE, LABELS), (2, len(CLASSES) ** 2, LABELS), (LABELS + 1, LABELS)]
    weights = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step, steps = 0, epochs * -(-len(sequences) // 96) + 1
    for _ in range(epochs):
        order = sorted(rng.permutation(len(sequences)), key=lambda i: len(sequences[i][1]) // 8)
        batches = [order[i : i + 96] for i in range(0, len(order), 96)]
        for b in rng.permutation(len(batches)):
            chosen = [sequences[i] for i in batches[b]]
            n, longest = len(chosen), max(len(s[1]) for s in chosen)
            keys, classes, endings, glue = (np.zeros((n, longest + 2 * WINDOW), np.int64) for _ in range(4))
            label, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
            for r, ((k, h, c, e), g, y) in enumerate(chosen):
                at = slice(WINDOW, WINDOW + len(k))
                keys[r, at] = np.where(rng.random(len(k)) < FORGET, h, k)  # texts hold words that the table doesn't know
                endings[r, at] = np.where(rng.random(len(k)) < FORGET, 0, e)
                classes[r, at], glue[r, at] = c, g
                label[r, : len(k)], mask[r, : len(k)] = y, True
            places_at = [slice(p, p + longest) for p in range(places)]
            score = sum(weights[0][p][keys[:, s]] + weights[1][p][classes[:, s]] + weights[2][p][endings[:, s]] for p, s in enumerate(places_at))
            glues = [glue[:, WINDOW : WINDOW + longest], glue[:, WINDOW + 1 : WINDOW + 1 + longest]]
            twos = [classes[:, WINDOW - 1 + k : WINDOW - 1 + k + longest] * len(CLASSES) + classes[:, WINDOW + k : WINDOW + k + longest] for k in (0, 1)]
            score = score + weights[3][0][glues[0]] + weights[3][1][glues[1]] + weights[4][0][twos[0]] + weights[4][1][twos[1]]
            pair = np.where(ALLOWED, weights[5], NEVER)
            forward = np.zeros((longest, n, LABELS))
            forward[0] = score[:, 0] + pair[LABELS]
            for t in range(1, longest):
                step_in = _lse(forward[t - 1][:, :, None] + pair[None, :LABELS], 1) + score[:, t]
                forward[t] = np.where(mask[:, t, None], step_in, forward[t - 1])
            total = _lse(forward[-1], 1)
            backward = np.zeros((longest, n, LABELS))
            pairs = np.zeros((LABELS + 1, LABELS))
            for t in range(longest - 1, 0, -1):
                on = mask[:, t]
                ahead = score[:, t] + backward[t]
                both = np.exp(forward[t - 1][:, :, None] + pair[None, :LABELS] + ahead[:, None, :] - total[:, None, None])
                pairs[:LABELS] += (both * on[:, None, None]).sum(0)
                backward[t - 1] = np.where(on[:, None], _lse(pair[None, :LABELS] + ahead[:, None, :], 2), backward[t])
            marginal = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
            pairs[LABELS] = marginal[:, 0].sum(0)
            gold = np.eye(LABELS)[label] * mask[:, :, None]
            diff = (gold - marginal).reshape(-1, LABELS)
            gold_pairs = np.zeros((LABELS + 1, LABELS))
            np.add.at(gold_pairs, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1)
            np.add.at(gold_pairs[LABELS], label[:, 0], 1)
            gradients = [np.zeros(s) for s in shapes]
            shifted = np.zeros((n, longest + 2 * WINDOW, places, LABELS))
            for p, s in enumerate(places_at):
                shifted[:, s, p] = diff.reshape(n, longest, LABELS)
            shifted = shifted.reshape(-1, places * LABELS)
            for k, held in enumerate((keys, classes, endings)):
                at, sums = _grouped(held.ravel(), shifted)
                gradients[k][:, at] = sums.reshape(-1, places, LABELS).transpose(1, 0, 2)
            for k in (0, 1):
                for g, held in ((gradients[3], glues[k]), (gradients[4], twos[k])):
                    at, sums = _grouped(held.ravel(), diff)
                    g[k, at] = sums
            gradients[5] = (gold_pairs - pairs) * ALLOWED
            step += 1
            for k, g in enumerate(gradients):
                g = g / n - PENALTY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] += 0.06 * (1 - step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    weights[1][WINDOW, :, 1:3] += LEAN
    return Model(reader, *[w.astype(np.float32) for w in weights[:5]], np.where(ALLOWED, weights[5], NEVER).astype(np.float32))


@lru_cache(maxsize=1)
def trained() -> Model:
    return train()


class Decoder:
    """Finds the items of many texts at a time."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.slots: dict[str, int] = {}
        self.glues: dict[str, int] = {}
        self.by_key: dict[tuple, int] = {}
        self.rows = [model.key_w[:, 0] + model.class_w[:, 0] + model.ending_w[:, 0]]
        self.traits = [(False, False, 0)]
        self.stack()
        pair = model.pair_w
        # what a label pair may gain over staying outside: with it, tokens that can't be part of an item are told apart exactly
        self.gain = max(0.0, float((pair[:LABELS] - pair[0, 0]).max()), float((pair[LABELS] - pair[LABELS, 0]).max()))

    def stack(self) -> None:
        self.emit = [np.ascontiguousarray(np.stack([r[p] for r in self.rows])) for p in range(2 * WINDOW + 1)]
        self.stop, self.plain, self.coarse = (np.array([t[k] for t in self.traits]) for k in (0, 1, 2))

    def number(self, token: str) -> int:
        """The row of a token's weights; as many rows as there are keys, classes and endings that occur together, however many tokens."""
        m, r = self.model, self.model.reader
        known, end, c = r.key(token), r.ending(token), r.coarse(token)
        plain = len(token) > 3 and token.islower()
        key = (known, c, end, plain, token in ".;!?")
        if key not in self.by_key:
            self.by_key[key] = len(self.rows)
            self.rows.append(m.key_w[:, known] + m.class_w[:, c] + m.ending_w[:, end])
            self.traits.append((token in ".;!?", plain, c))
        if len(self.slots) > 500_000:
            self.slots.clear()
        self.slots[token] = self.by_key[key]
        return self.by_key[key]

    def labels(self, many: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
        pad = [0] * WINDOW
        ids, glue, spans = list(pad), list(pad), []
        for toks, gaps in many:
            own = list(map(self.slots.get, toks))
            if None in own:
                own = [self.number(t) if v is None else v for t, v in zip(toks, own)]
            stuck = list(map(self.glues.get, gaps))
            if None in stuck:
                if len(self.glues) > 10_000:
                    self.glues.clear()
                self.glues |= {g: glue_of(g) for g in gaps}
                stuck = [glue_of(g) for g in gaps]
            spans.append((len(ids), len(ids) + len(own)))
            ids += own
            ids += pad
            glue += stuck[:-1]
            glue += pad
        if len(self.rows) > len(self.stop):
            self.stack()
        flat, stuck = np.array(ids), np.array(glue)
        n = len(flat) - 2 * WINDOW
        score = np.zeros((len(flat), LABELS), np.float32)
        inner = score[WINDOW : WINDOW + n]
        for p, rows in enumerate(self.emit):
            inner += rows.take(flat[p : p + n], axis=0)
        inner += self.model.glue_w[0].take(stuck[WINDOW : WINDOW + n], axis=0)
        inner += self.model.glue_w[1].take(stuck[WINDOW + 1 : WINDOW + 1 + n], axis=0)
        kind = self.coarse.take(flat)
        two = kind[:-1] * len(CLASSES) + kind[1:]
        inner += self.model.two_w[0].take(two[WINDOW - 1 : WINDOW - 1 + n], axis=0)
        inner += self.model.two_w[1].take(two[WINDOW : WINDOW + n], axis=0)
        turned = np.ascontiguousarray(score.T)
        heard = np.concatenate([[0], np.cumsum(turned[1:].max(axis=0) - turned[0] + 2 * self.gain > 0)])
        # a text is decoded in pieces that end with a sentence
        end = self.stop[flat]
        end[1:] &= self.plain[flat[:-1]]
        ends = np.flatnonzero(end) + 1
        first, last = np.array([b for b, _ in spans], np.int64), np.array([e for _, e in spans], np.int64)
        ends = np.unique(np.concatenate([ends, last, first]))
        begin, stop = ends[:-1], ends[1:]
        live = (stop > begin) & (heard[stop] > heard[begin]) & ~np.isin(begin, last[last != np.concatenate([first[1:], [-1]])])
        begin, stop = begin[live], stop[live]
        out = np.zeros(len(flat), np.int64)
        self.decode(score, begin, stop, out)
        # a word that is part of a name at one place of a text likely is at the others
        again = []
        for (toks, _), b, e in zip(many, first, last):
            at = np.flatnonzero((out[b:e] == 1) | (out[b:e] == 2)).tolist()
            if at:
                words = {w for i in at if len(toks[i]) > 3 and toks[i][0].isupper() for w in (toks[i], toks[i].upper(), toks[i].capitalize())}
                again += [b + i for i, t in enumerate(toks) if t in words]
        if again:
            more = np.array(again)
            more = more[out[more] == 0]
            score[more, 1:3] += AGAIN
            # pieces that hold such a word, those passed over before included
            hit = np.unique(np.searchsorted(ends, more, side="right")) - 1
            self.decode(score, ends[hit], ends[hit + 1], out)
        return [out[b:e] for b, e in spans]

    def decode(self, score: np.ndarray, begin: np.ndarray, stop: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(stop - begin, kind="stable")
        for i in range(0, len(order), 1024):
            self.viterbi(score, begin[order[i : i + 1024]], (stop - begin)[order[i : i + 1024]], out)

    def viterbi(self, score: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """The best labels of pieces in the order of their size."""
        pair = self.model.pair_w
        longest = int(size[-1])
        best = score[start] + pair[LABELS]
        back = np.zeros((longest, len(start), LABELS), np.int8)
        turned = np.ascontiguousarray(pair[:LABELS].T)
        from_ = np.searchsorted(size, np.arange(longest), side="right")  # pieces from here on have a token t
        for t in range(1, longest):
            k = from_[t]
            ways = best[k:, None, :] + turned
            step = ways.argmax(axis=2)
            back[t, k:] = step
            won = ways.reshape(-1).take(step.ravel() + np.arange(0, ways.size, LABELS)).reshape(step.shape)
            best[k:] = won + score[start[k:] + t]
        label = best.argmax(axis=1)
        rows = np.arange(len(start))
        for t in range(longest - 1, -1, -1):
            k = from_[t]
            out[start[k:] + t] = label[k:]
            if t:
                label[k:] = back[t, rows[k:], label[k:]]


SPACE = re.compile(r"\s+")
NUMBERED = re.compile(r"\d+\.?\s+(?=\d)")
JOINED = re.compile(r"\s+(?:and|und|et)\s+")
POSSESSIVE = re.compile(r"['’]s$")
ACCEPT: dict[str, Callable[[str], bool]] = {
    "name": lambda v: bool(re.search(r"[^\W\d_]{2}", v)) and not re.search(r"[\d@]", v),
    "email": lambda v: bool(re.search(r"@|\bat\b", v, re.I)) and bool(re.search(r"\.|\bdot\b", v, re.I)),
    "phone": lambda v: sum(c.isdigit() for c in v) >= 6,
    "idnum": lambda v: sum(c.isdigit() for c in v) >= 5,
    "address": lambda v: bool(re.search(r"\d", v)) and bool(re.search(r"[^\W\d_]{3}", v)),
}


def exact(text: str, s: int, e: int, kind: str) -> list[tuple[int, int]]:
    """The ends of an item put right: no possessive on names, no paragraph number before an address, numbers joined by a word apart."""
    value = text[s:e]
    if kind == "name":
        return [(s, s + len(POSSESSIVE.sub("", value)))]
    if kind == "address" and (m := NUMBERED.match(value)):
        return [(s + m.end(), e)]
    if kind == "phone":
        out, at = [], 0
        for m in [*JOINED.finditer(value), None]:
            stop = m.start() if m else len(value)
            out.append((s + at, s + stop))
            at = m.end() if m else stop
        return out
    return [(s, e)]


def items(text: str, toks: list[str], gaps: list[str], label: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items that the labels mark; masked ones and those that can't be of their kind are left out."""
    found = []
    heads = np.flatnonzero(label % 2 == 1)
    if not len(heads):
        return []
    ends = list(accumulate(map(add, map(len, gaps), map(len, toks))))
    marks = label.tolist()
    for h in heads.tolist():
        kind = marks[h] // 2
        last = h
        while last + 1 < len(marks) and marks[last + 1] == marks[h] + 1:
            last += 1
        s, e = ends[h] - len(toks[h]), ends[last]
        for s, e in exact(text, s, e, KINDS[kind]):
            value = text[s:e]
            if "*" not in value and "█" not in value and ACCEPT[KINDS[kind]](value):
                found.append((s, e, KINDS[kind]))
    return found


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, kind in found:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def _finder(model: Model, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                read = [tokens(t or "") for t in texts]
                found = [items(t or "", r[0], r[1], y) for t, r, y in zip(texts, read, decoder.labels(read))]
                values = [[{"kind": k, "value": SPACE.sub(" ", t[s:e])} for s, e, k in f] for t, f in zip(texts, found)]
                clean = [t if t is None else masked(t, f) for t, f in zip(texts, found)] if with_text else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(clean, pa.string()), pa.array(values, kind)], names=["doc_id", "text", "items"])

    return run


def find(documents: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """Each document as (doc_id, text, items): the text with every item replaced by [NAME], [EMAIL], [PHONE],
    [IDNUM] or [ADDRESS], the rest unchanged, and the items as (kind, value) in their order.

    ``value`` is the item as it stands in the text, each run of white space turned into one space. Null texts
    stay null and have no items, as have empty ones. Every row gives one row; other columns don't come out.
    ``with_text=False`` leaves the text null, where only the items are wanted.

    The field is trained on the driver, once, from a labelled table that is part of this package and as large at every
    size of data; texts are read where they lie, without a shuffle.
    """
    return map_arrow(documents.select("doc_id", "text"), _finder(model or trained(), with_text), "doc_id bigint, text string, items array<struct<kind: string, value: string>>")


def found_items(documents: DataFrame) -> DataFrame:
    """Distinct (doc_id, kind, value)."""
    return find(documents, with_text=False).select("doc_id", F.explode(F.array_distinct("items")).alias("i")).select("doc_id", "i.kind", "i.value")
