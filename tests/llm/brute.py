"""Plain, slow versions of the operators, to hold their results against."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def union(items, links) -> dict:
    """item -> smallest item reachable."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


# lines


def removed_lines(docs: list[tuple], t: float = 0.8) -> dict[int, dict[int, str]]:
    """doc_id -> line number -> exact or near, for (doc_id, text) rows of different doc_ids."""
    lines = [(i, k, line) for i, text in sorted(docs) for k, line in enumerate((text or "").split("\n")) if WORDS(line)]
    out: dict[int, dict[int, str]] = {i: {} for i, _, _ in lines}
    seen: dict[str, set] = {}
    for i, k, line in lines:
        if line in seen:
            out[i][k] = "exact"
            continue
        words = WORDS(line)
        own = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        if any(len(own & other) >= t * len(own | other) - 1e-9 for other in seen.values()):
            out[i][k] = "near"
        seen[line] = own
    # equal lines of one that is near are exact: they equal an earlier line
    return out


# secrets

KINDS = ("assign", "access", "hex")
PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.ASCII),
    re.compile("(AKIA[A-Z0-9]+)"),
    re.compile("([0-9a-f]+)"),
)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end)."""
    least = (8, 16, 32)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[m.re.groups]) >= least[k])


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# fingerprints


def fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS(lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_fingerprints(docs: list[tuple], radius: int = 4) -> dict[int, tuple[str, int]]:
    fp = {i: fingerprint(text) for i, text in docs}
    values = np.array(sorted(set(fp.values())), np.uint64)
    links = []
    for k in range(len(values)):
        near = np.nonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius)[0] + k + 1
        links += [(int(values[k]), int(values[j])) for j in near]
    classes, least = union(fp.values(), links), {}
    for i in sorted(fp):
        least.setdefault(classes[fp[i]], i)
    return {i: (f"{f:016x}", least[classes[f]]) for i, f in fp.items()}


# vectors


def near_vectors(rows: list[tuple], limit: float = 0.9) -> dict[int, tuple[int, int]]:
    """vec_id -> (links, component_id), for different vec_ids and usable vectors of one length."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= limit
    np.fill_diagonal(near, False)
    classes = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    return {i: (int(near[k].sum()), classes[i]) for k, i in enumerate(ids)}


# quality


def quality_base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORDS(text)
    lines = [x for x in text.split("\n") if WORDS(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for k, w in enumerate(windows) if counts[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def log_ratios(docs: list[tuple], trusted: set[int], cells: int) -> dict[int, float]:
    """doc_id -> the mean log-likelihood ratio."""

    def grams(text):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS(text or "")]
        out = [h & (cells - 1) for h in hashes]
        for a, b in zip(hashes, hashes[1:]):
            first = xxhash.xxh64_intdigest(struct.pack("<q", _signed(a)), 42)
            out.append(xxhash.xxh64_intdigest(struct.pack("<q", _signed(b)), first) & (cells - 1))
        return out

    raw, target = Counter(), Counter()
    for i, text in docs:
        here = grams(text)
        raw.update(here)
        if i in trusted:
            target.update(here)
    all_raw, all_target = raw.total() + cells, target.total() + cells
    score = lambda c: math.log((target[c] + 1) / all_target) - math.log((raw[c] + 1) / all_raw)
    return {i: sum(map(score, g)) / max(1, len(g)) for i, text in docs for g in [grams(text)]}


# language model


def backoff_scores(texts: list[str | None]) -> list[tuple[int, float]]:
    """(tokens, sum of logs) of each text, its own counts left out of those of all."""
    rows = [(t or "").encode().lower().split() for t in texts]
    single, pair, total = Counter(), Counter(), 0
    for words in rows:
        single.update([None, *words])
        pair.update(zip([None, *words], words))
        total += len(words)
    out = []
    for words in rows:
        own_single, own_pair = Counter([None, *words]), Counter(zip([None, *words], words))
        score = 0.0
        for a, b in zip([None, *words], words):
            n = pair[a, b] - own_pair[a, b]
            if n > 0:
                score += math.log(n / max(1, single[a] - own_single[a]))
            else:
                score += math.log(0.4 * max(1, single[b] - own_single[b]) / max(1, total - len(words)))
        out.append((len(words), score))
    return out


# packing


def packing_faults(rows: list, texts: dict[int, str | None], encode, capacity: int = 4096) -> list[str]:
    """What is wrong with pieces of documents of different doc_ids; encode gives a text's ids as bytes."""
    out, pieces, sequences = [], defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    if set(pieces) != set(texts):
        out.append("documents differ")
    for i, text in texts.items():
        data, at = encode(text or "") + struct.pack("<I", 2), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = data[4 * r.start : 4 * (r.start + r.length)]
            if r.start != at or r.length < 1 or zlib.crc32(part) != r.ids_crc32 or r.doc_tokens != len(data) // 4:
                out.append(f"piece of {i} at {r.start}")
            at += r.length
        if 4 * at != len(data):
            out.append(f"{i} ends at {at}")
    for k, found in sequences.items():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            if r.offset != at:
                out.append(f"sequence {k} has a gap at {at}")
            at += r.length
        if at > capacity:
            out.append(f"sequence {k} has {at} tokens")
    return out


def padding(rows: list, capacity: int = 4096) -> float:
    """Share of padding, where sequences of a power of two need none."""
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    padded = sum(n if n & (n - 1) == 0 else capacity for n in sizes.values())
    return 1 - sum(sizes.values()) / padded


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
