"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus' frequent words (counted over every text, the table bounded by a
parameter) are compiled into a minimal acyclic automaton whose shared suffixes
are stored once. Each arc carries the number of words that sort before it, so
the sum along a path is the word's rank, its address in the table of id
sequences. The compiled lexicon is a flat byte string: it is broadcast (its size
is bounded by the word count), written once per Python worker to an anonymous
file and memory-mapped. Words outside it are merged exactly by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import light, ship, table, text_of

#: Bound on the words of a lexicon: at most some MB when compiled.
MAX_WORDS = 32_768
#: Bytes of a generation of remembered words, about; there are two.
MEMO_BYTES = 48 << 20
#: Different words that a task counts before it hands them on, some 90 MB.
MAX_COUNTED = 1 << 19

SPACES = "\t-\r \x85\xa0  -     　"


def _assigned() -> Iterator[str]:
    """All characters but those of planes where none is assigned."""
    for low, high in ((0x80, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000)):
        yield from map(chr, range(low, high))


def _class(characters: Iterable[str]) -> str:
    """A character class body with the characters, which come in order."""
    runs: list[list[int]] = []
    for c in map(ord, characters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs)


def _up_to(top: int, body: str) -> str:
    """The class body without the characters beyond top."""
    runs = ((int(lo, 16), int(hi, 16)) for lo, hi in re.findall(r"\\U(\w{8})-\\U(\w{8})", body))
    return "".join(f"\\U{lo:08x}-\\U{min(hi, top):08x}" for lo, hi in runs if lo <= top)


def normalized(text: str) -> str:
    """NFC and lower case, by Python's tables."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # lower() makes a final sigma of it by context


@cache
def library_normalizer():
    from tokenizers import Regex, normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])


@cache
def tables() -> tuple[str, str, str]:
    """Character class bodies: letters, numbers, and characters that the tokenizers library normalizes by other tables than Python.

    The first two are read from the library's own patterns, as its and Python's
    versions of Unicode differ; the last are found by comparing both over all
    characters, orders of marks and compositions. Without the library they are
    Python's, and there are none of the last.
    """
    ascii_letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
    every = [*_assigned()]
    try:
        from tokenizers import Regex, pre_tokenizers
    except ImportError:
        of = lambda kind: _class([*(ascii_letters if kind == "L" else digits), *(c for c in every if unicodedata.category(c)[0] == kind)])
        return of("L"), of("N"), ""

    def found(pattern: str, plain: str) -> str:
        pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(every))
        return _class([*plain, *(c for piece, _ in pieces for c in piece)])

    blank = re.compile(f"[{SPACES}]+")

    def differ(texts: list[str]) -> list[bool]:
        there = library_normalizer().normalize_str("\x01".join(texts)).split("\x01")
        return [blank.sub(" ", normalized(x)) != y for x, y in zip(texts, there, strict=True)]

    odd = {c for c, d in zip(every, differ(every)) if d}
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    for probe in ("\u0334", "\u0356", "\u0315", "\u0345"):  # of classes 1, 220, 232 and 240
        for pairs in ([f"a{c}{probe}" for c in marks], [f"a{probe}{c}" for c in marks]):
            odd |= {c for c, d in zip(marks, differ(pairs)) if d}
    parts = [x for c in every if (x := unicodedata.normalize("NFD", c)) != c]
    odd |= {c for x, d in zip(parts, differ(parts)) if d for c in x}
    return found(r"\p{L}+", ascii_letters), found(r"\p{N}+", digits), _class(sorted(odd))


#: Bytes of a word beyond which merges come from a heap.
LONG = 128
#: In place of a rank: the pair is never merged.
NEVER = 1 << 60

_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Where classes reach beyond these planes, patterns go through their ranges one by one.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def word_pattern(letters: str, numbers: str) -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of anything else but white space."""
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{letters}{numbers}]+")


@cache
def letters_pattern(letters: str) -> re.Pattern:
    """Runs of letters."""
    return re.compile(f"[{letters}]+")


def finder(pattern: Callable[..., re.Pattern], *classes: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, found with its classes cut to the text's range of characters."""
    wide = pattern(*classes).findall
    plain, middle = (pattern(*(_up_to(top, c) for c in classes)).findall for top in (0x7F, 0xFFFF))

    def find(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return wide(text) if _BEYOND.search(text) else middle(text)

    return find


def word_finder(letters: str, numbers: str) -> Callable[[str], list[str]]:
    return finder(word_pattern, letters, numbers)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file: ids, merge ranks and special strings."""

    _open: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id and right id in one number -> rank and the joined token's id in one number
        self.ranks = {self.ids[x] << 20 | self.ids[y]: k << 20 | self.ids[x + y] for k, (x, y) in enumerate(pairs)}
        #: left id -> right id -> the same
        self.after: list[dict[int, int]] = [{}] * (max(self.ids.values()) + 1)
        for pair, found in self.ranks.items():
            if not self.after[pair >> 20]:
                self.after[pair >> 20] = {}
            self.after[pair >> 20][pair & 0xFFFFF] = found
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        alphabet = byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.last = [self.ids[c + self.suffix] for c in alphabet]
        #: by two bytes: what ranks has for them within a word, and at its end
        self.pairs = [[self.ranks.get(x << 20 | y, NEVER) for y in self.inner] for x in self.inner]
        self.ends = [[self.ranks.get(x << 20 | y, NEVER) for y in self.last] for x in self.inner]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merge(self, word: str) -> tuple[int, ...]:
        """The word's ids: always join the adjacent pair of lowest rank, leftmost first."""
        data = word.encode("utf-8", "surrogatepass")
        parts = [*map(self.inner.__getitem__, data)]
        parts[-1] = self.last[data[-1]]
        if len(parts) > LONG:
            return self._merge_long(parts)
        after, never = self.after, NEVER
        at = [row[b] for row, b in zip(map(self.pairs.__getitem__, data), data[1:])]
        if at:
            at[-1] = self.ends[data[-2]][data[-1]]
        while at:
            low = min(at)
            if low == never:
                break
            k = at.index(low)
            joined = parts[k] = low & 0xFFFFF
            del at[k], parts[k + 1]
            if k:
                at[k - 1] = after[parts[k - 1]].get(joined, never)
            if k < len(at):
                at[k] = after[joined].get(parts[k + 1], never)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same merges from a heap of pairs, in time n log n; what a merge has made stale is passed over."""
        rank, n = self.ranks.get, len(parts)
        after, before, gone = [*range(1, n + 1)], [*range(-1, n - 1)], bytearray(n)

        def pair(k: int) -> tuple[int, int] | None:
            found = rank(parts[k] << 20 | parts[after[k]], NEVER) if k >= 0 and after[k] < n else NEVER
            return (found, k) if found != NEVER else None

        heap = [x for k in range(n - 1) if (x := pair(k))]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            if gone[k] or pair(k) != (low, k):
                continue
            right = after[k]
            parts[k], after[k], gone[right] = low & 0xFFFFF, after[right], 1
            if after[k] < n:
                before[after[k]] = k
            for x in (pair(before[k]), pair(k)):
                if x:
                    heapq.heappush(heap, x)
        return tuple(p for p, out in zip(parts, gone) if not out)


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer of the words as bytes.

    Words are added in order; each state whose last arc is done is replaced by an
    equal registered one, which keeps the automaton minimal all the time.
    """
    words = sorted(w for w in entries if w)
    arcs: list[dict[str, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path, before = [0], ""

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                arcs[path[-1]][before[len(path) - 1]] = same

    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        freeze(common)
        for c in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = word
    freeze(0)

    number, order = {0: 0}, [0]  # reachable states, breadth first
    for state in order:
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            waits = [t for t in arcs[s].values() if t not in below]
            if waits:
                todo.extend(waits)
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                todo.pop()
        return below[state]

    count(0)
    starts, labels, targets, skips, ends = [], [], [], [], []
    for state in order:
        starts.append(len(labels))
        ends.append(int(final[state]))
        passed = int(final[state])
        for c in sorted(arcs[state]):
            labels.append(ord(c))
            targets.append(number[arcs[state][c]])
            skips.append(passed)
            passed += below[arcs[state][c]]
    starts.append(len(labels))
    offsets, ids = [0], []
    for word in words:
        ids.extend(entries[word])
        offsets.append(len(ids))
    columns = [starts, ends, labels, targets, skips, offsets, ids]
    return struct.pack("<7I", *map(len, columns)) + b"".join(struct.pack(f"<{len(c)}I", *c) for c in columns)


class Lexicon:
    """A compiled lexicon, memory-mapped from an anonymous file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing stays in the executor's folder
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, sizes, at = memoryview(self.map), struct.unpack_from("<7I", self.map), 28
        columns = []
        for n in sizes:
            columns.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.starts, self.ends, self.labels, self.targets, self.skips, self.offsets, self.ids = columns

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def find(self, word: str) -> tuple[int, ...] | None:
        state = rank = 0
        for c in word:
            high, code = self.starts[state + 1], ord(c)
            k = bisect_left(self.labels, code, self.starts[state], high)
            if k == high or self.labels[k] != code:
                return None
            rank += self.skips[k]
            state = self.targets[k]
        if not self.ends[state]:
            return None
        return tuple(self.ids[self.offsets[rank] : self.offsets[rank + 1]])


class _Aging(dict):
    """Remembers what it made for short keys, in two generations of bounded bytes: a full one becomes the old one, which is asked before making anew."""

    def __init__(self, most: int):
        self.most = self.room = most
        self.old: dict = {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.made(key)
        if len(key) <= 64:
            self.room -= 240 + 2 * len(key) + len(out)  # with both objects and their share of the table
            if self.room < 0:
                self.old = dict(self)
                self.forget()
            self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.room = self.most


class _Memo(_Aging):
    """A word, or a chunk of text between white space -> its ids as bytes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, most: int, find: Callable[[str], list[str]]):
        super().__init__(most)
        self.vocabulary, self.lexicon, self.find = vocabulary, lexicon, find

    def made(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() and chunk.isascii() else self.find(chunk)
        if len(words) != 1:
            return b"".join([self[word] for word in words])
        ids = self.lexicon.find(chunk) if self.lexicon else None
        return array("I", self.vocabulary.merge(chunk) if ids is None else ids).tobytes()


class _Spelled(_Aging):
    """A chunk -> its tokens, as decoded."""

    def __init__(self, memo: _Memo, most: int):
        super().__init__(most)
        self.memo, self.tokens = memo, memo.vocabulary.tokens

    def made(self, chunk: str) -> str:
        return " ".join(map(self.tokens.__getitem__, array("I", self.memo[chunk])))


class Encoder:
    """Encodes whole texts; gives the ids as little-endian unsigned 32-bit integers."""

    _kept: tuple[tuple, Encoder] | None = None

    @classmethod
    def load(cls, path: str, lexicon: bytes | None = None, most: int = MEMO_BYTES, classes: tuple[str, str, str] | None = None) -> Encoder:
        """The worker's encoder, one at most, kept from task to task with the words it remembers."""
        key = (path, hashlib.sha256(lexicon or b"").digest(), most)
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = None
            cls._kept = (key, cls(path, lexicon, most, classes))
        return cls._kept[1]

    def __init__(self, path: str, lexicon: bytes | None = None, most: int = MEMO_BYTES, classes: tuple[str, str, str] | None = None):
        """classes: those of tables(), where another process has them already."""
        self.vocabulary = Vocabulary.load(path)
        letters, numbers, odd = classes or tables()
        self.words = word_finder(letters, numbers)
        self.odd = re.compile(f"[{odd}]").search if odd else None
        self.maybe_odd = re.compile(f"[{_up_to(0xFFFF, odd)}{_BEYOND.pattern[1:-1]}]").search
        self.memo = _Memo(self.vocabulary, Lexicon(lexicon) if lexicon else None, most, self.words)
        self.spelled = _Spelled(self.memo, most)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")").split
        for text, k in self.vocabulary.special.items():
            self.fixed = getattr(self, "fixed", {}) | {text: struct.pack("<I", k)}

    def chunks(self, text: str) -> list[str]:
        """The lower-cased text between white space. A word never reaches across it."""
        if text.isascii():
            text = text.lower()
        elif self.odd and self.maybe_odd(text) and self.odd(text):
            return self.words(library_normalizer().normalize_str(text))
        else:
            text = normalized(text)
        if _SEPARATORS.search(text):  # split() takes them for white space, the vocabulary doesn't
            return self.words(text)
        return text.split()

    def encode(self, text: str) -> bytes:
        get = self.memo.__getitem__
        if "<|" not in text:
            return b"".join(map(get, self.chunks(text)))
        return b"".join(self.fixed[part] if part in self.fixed else b"".join(map(get, self.chunks(part))) for part in self.split(text))

    def decoded(self, text: str) -> str:
        """What the ids of the text decode to: this vocabulary's tokens joined by spaces."""
        get = self.spelled.__getitem__
        if "<|" not in text:
            return " ".join(map(get, self.chunks(text)))
        return " ".join(x for part in self.split(text) for x in ([part] if part in self.fixed else map(get, self.chunks(part))))

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        if "<|" in text:
            return self.encode(text), self.decoded(text)
        chunks = self.chunks(text)
        return b"".join(map(self.memo.__getitem__, chunks)), " ".join(map(self.spelled.__getitem__, chunks))


def decode(data: bytes, path: str) -> str:
    """The tokens of little-endian ids joined by spaces; special ones are kept."""
    tokens = Vocabulary.load(path).tokens
    return " ".join(tokens[i] for i in struct.unpack(f"<{len(data) // 4}I", data))


def count_words(texts: Iterable[str], letters: str, share: int, most: int = MAX_COUNTED) -> Iterator[dict[str, int]]:
    """The counts of the texts' lower-cased words of letters, in parts of about most different words, with their total as that of "".

    A part leaves out the words that are less than one in share of its own, so a
    word's sum lacks less than one in share of all words.
    """
    find, counts = finder(letters_pattern, letters), Counter()

    def part() -> dict[str, int]:
        total = sum(counts.values())
        return {w: n for w, n in counts.items() if n * share >= total} | {"": total}

    for text in texts:
        counts.update(find(text.lower()))
        if len(counts) >= most:
            yield part()
            counts.clear()
    yield part()


def frequent_words(docs: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The words of letters that make up at least one in max_words of the corpus' words; so there are max_words at most.

    They are counted over every whole text, by Python workers: as rows of single
    words they made an executor's JVM twice as large, for the rest of its life.
    Counts can be too low by one in 8 * max_words of all words, so a word that
    only just is frequent may not be listed; none is that isn't.
    """
    letters = tables()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in count_words((text for batch in batches for text in columns(batch, "text")[0]), letters, 8 * max_words):
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    counts = docs.select(text_of().alias("text")).mapInArrow(light(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))
    total = counts.agg(F.max(F.when(F.col("word") == "", F.col("count")))).scalar()
    return [r.word for r in counts.where(F.col("count") * max_words >= total).collect() if r.word]  # a condition on word would part the two exchanges, and texts be counted twice


def build_lexicon(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> bytes:
    merge = Vocabulary.load(path).merge
    return compile_lexicon({w: merge(w) for w in frequent_words(docs, max_words)})


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def encode_documents(docs: DataFrame, path: str, lexicon: bytes | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Null texts count as empty: no tokens, digests of nothing. Repeated rows give
    repeated results. Other columns of docs are ignored, whatever their names.
    An empty table gives no rows. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    shared, classes = spark.sparkContext.broadcast(lexicon) if lexicon else None, tables()
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, shared.value if shared else None, classes=classes)
        sha = hashlib.sha256
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            n, first, second, kept = [], [], [], []
            for text in texts:
                data, back = encoder.encode_and_decode(text)
                n.append(len(data) // 4)
                first.append(sha(data).hexdigest())
                second.append(sha(back.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    kept.append(data)
            arrays = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    ship(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(light(run), kind)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = tokenizer_path()
    return encode_documents(docs, path, build_lexicon(docs, path))
