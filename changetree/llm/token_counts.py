"""Operator 7, token counts: finite-state tokenizer compilation.

A byte-pair vocabulary is compiled into a deterministic transducer. Reading a word symbol by symbol,
its state holds the vocabulary prefixes that end here and, for each place at which a token may still
begin, the last token of the unique encoding up to that place; a transition is annotated with the
tokens it adds to the count. That the encoding of a prefix has one last token, found among its suffixes
by testing neighbours only, is the known property of ranked merges: a sequence is the encoding of its
text exactly when each pair of neighbours is. Transitions are compiled when they are first taken.

A text is cut into chunks. A chunk's state map is (head, count, tail): the pending symbols of the state
it is entered in join head, those between the first and the last white space count by themselves, and
tail is the state it leaves. Maps compose associatively, and a prefix scan that doubles its stride
gives the state and the count behind every chunk."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain, islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table

#: Characters in a chunk; a scan over a text's chunks composes their maps.
CHUNK = 1 << 16
#: Words and states that a task keeps; beyond it the tables start anew. Bounds memory, not results.
MOST_WORDS, LONG_WORD, MOST_STATES = 1 << 18, 64, 1 << 17


# The word pattern of the vocabulary file, and what it is on lower-case ASCII text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \t-\ra-z0-9]+"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Remembered:
    """What was found for words before. When MOST_WORDS are held the table becomes the old one, from which
    words that turn up again are taken over, and a new one starts. Words of more than LONG_WORD characters are
    found anew each time, so the tables are bounded in bytes too."""

    def __init__(self):
        self.now: dict = {}
        self.old: dict = {}

    def all(self, words: list[str], find) -> list:
        """The values of all words, in order; find gets a list of new words and gives their values."""
        if len(self.now) > MOST_WORDS:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        missing = set(words).difference(now)
        if missing:
            now.update((w, old[w]) for w in missing if w in old)
            if new := [w for w in missing if w not in now]:
                now.update(zip(new, find(new)))
        out = [*map(now.__getitem__, words)]
        for w in missing:
            if len(w) > LONG_WORD:
                del now[w]
        return out

    def trim(self, most: int) -> None:
        """Forget all but the `most` words that were found first, which are the frequent ones."""
        self.now, self.old = dict(islice(chain(self.old.items(), self.now.items()), most)), {}


class Transducer:
    """The compiled vocabulary. count(word) runs it over a word's symbols."""

    def __init__(self, model: dict):
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.ignore_merges = model.get("ignore_merges", False)
        made = {a + b for a, b in self.ranks}
        singles = byte_symbols()
        tokens = [t for t in {*singles, *(s + self.end for s in singles), *made} if t in model["vocab"]]
        self.units = {self.split(t): t for t in tokens}
        self.prefixes = {u[:k] for u in self.units for k in range(1, len(u) + 1)}
        self.valid: dict[tuple, bool] = {}
        self.pairs: dict[tuple, bool] = {}
        self.words = Remembered()
        self.reset()

    def split(self, text: str) -> tuple[str, ...]:
        """A token's symbols; the end of a word belongs to the symbol before it."""
        if self.end and text.endswith(self.end) and len(text) > len(self.end):
            body = text[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(text)

    def merged(self, symbols) -> list[str]:
        """The encoding of a short symbol sequence by ranked merges."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.ranks.get(p, 1 << 40))
            if best not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, left: tuple | None, right: tuple) -> bool:
        """Whether right may stand behind left (None: the word's beginning) in an encoding."""
        if left is None:
            known = self.valid.get(right)
            if known is None:
                known = self.valid[right] = self.merged(right) == [self.units[right]]
            return known
        known = self.pairs.get((left, right))
        if known is None:
            known = self.follows(None, right) and self.merged(left + right) == [self.units[left], self.units[right]]
            self.pairs[left, right] = known
        return known

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.start = self.state(((), ((0, None, 0),)))

    def state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return at

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition of a state by a symbol: the next state and the tokens it adds.

        A state is (recent symbols, open places); an open place is (its distance back, the last token
        there, the count there less the count here)."""
        recent, places = self.keys[state]
        recent = (*recent, symbol)
        last, added = None, None
        for back, left, count in places:  # from the farthest place: any that fits is the only one
            token = recent[len(recent) - back - 1 :]
            if token in self.units and self.follows(left, token):
                last, added = token, count + 1
                break
        if added is None:
            raise ValueError(f"no encoding ends with {symbol!r}")
        going = [(b + 1, left, c - added) for b, left, c in places if recent[len(recent) - b - 1 :] in self.prefixes]
        longest = max((b for b, _, _ in going), default=0)
        step = self.state((recent[len(recent) - longest :] if longest else (), (*going, (0, last, 0)))), added
        self.steps[state][symbol] = step
        return step

    def run(self, word: str) -> int:
        shown = [byte_symbols()[b] for b in word.encode("utf-8")]
        shown[-1] += self.end
        if len(self.keys) > MOST_STATES:
            self.reset()
        if len(self.pairs) > MOST_STATES:
            self.pairs.clear()
        at, total, steps = self.start, 0, self.steps
        for s in shown:
            step = steps[at].get(s)
            if step is None:
                step = self.compile(at, s)
            at = step[0]
            total += step[1]
        return total

    def count(self, words: list[str]) -> int:
        """Tokens of the words; each distinct one runs through the transducer once."""
        return sum(self.words.all(words, lambda new: map(self.run, new)))


class Counter:
    """A tokenizer file of kind byte-level BPE: its normaliser and word splitter before a Transducer."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        parts = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        self.nfc = any(p["type"] == "NFC" for p in parts)
        self.lower = any(p["type"] == "Lowercase" for p in parts)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if spec["model"]["type"] != "BPE" or not (split["behavior"] == "Removed" and split["invert"]) or not all(p["type"] in ("NFC", "Lowercase", "Replace") for p in parts):
            raise ValueError("only byte-level BPE files that keep the matches of one pattern are compiled")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        known = self.lower and split["pattern"]["Regex"] == WORD_PATTERN
        self.ascii_words = re.compile(ASCII_WORDS).findall if known else self.words
        self.added = regex.compile("|".join(regex.escape(a["content"]) for a in spec["added_tokens"]) or r"(?!)")
        self.model = spec["model"]
        self.space = regex.compile(r"\s")

    @cached_property
    def machine(self) -> Transducer:
        return Transducer(self.model)

    def pieces(self, text: str) -> list[str]:
        """The words of a text without added tokens' strings; white space never is inside a word."""
        if text.isascii():
            return self.ascii_words(text.lower() if self.lower else text)
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter, without the rule for final sigma
        return self.words(text)

    def closed(self, text: str) -> int:
        return self.machine.count(self.pieces(text)) if text else 0

    def chunk_map(self, chunk: str) -> tuple:
        """(head, count, tail), or (chunk,) where no white space resets the state."""
        first = self.space.search(chunk)
        if not first:
            return (chunk,)
        last = len(chunk) - 1
        while not chunk[last].isspace() or not self.space.match(chunk[last]):
            last -= 1
        return chunk[: first.start()], self.closed(chunk[first.start() : last + 1]), chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring stretches."""
        if len(a) == 1 and len(b) == 1:
            return (a[0] + b[0],)
        if len(a) == 1:
            return a[0] + b[0], b[1], b[2]
        if len(b) == 1:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions; each round doubles the stride (work-efficient form: pairs are
        composed first, and the scan of the pairs gives every second prefix)."""
        if len(maps) <= 1:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        prefix = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(prefix[i // 2] if i % 2 else self.compose(prefix[i // 2 - 1], maps[i]))
        return out

    def total(self, text: str) -> int:
        """Tokens of a stretch without added tokens."""
        if len(text) <= CHUNK:
            return self.closed(text)
        # NFC composes across a cut unless white space is there, so chunks are cut raw and normalised in closed()
        end = self.scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])[-1]
        return self.closed(end[0]) if len(end) == 1 else self.closed(end[0]) + end[1] + self.closed(end[2])

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        stretches = self.added.split(text) if "<" in text else [text]
        return sum(map(self.total, stretches)) + len(stretches) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The compiled tokenizer, once in each Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) behind its columns (underscores are
    added to names that docs has already); one row for each row of docs, without a shuffle.

    A null text counts as empty: no bytes, no tokens, not over the limit. Strings of added tokens in a text
    count as one token each, as the library has it. Repeated rows are all kept; an empty table gives an empty
    result. The tokenizer file has to be at tokenizer_path on every executor."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([*map(counter(tokenizer_path).tokens, texts)], dtype="int64")

    n_bytes, n_tokens, over = (free_name(docs, c) for c in ("n_bytes", "n_tokens", "over_limit"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumn(n_bytes, F.octet_length(text).cast("long")).withColumn(n_tokens, count(text))
    return counted.withColumn(over, F.col(n_tokens) > limit)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, default_tokenizer()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
