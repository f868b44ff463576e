"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from tallybook.llm.quality_rules import MAX_REPEATED_PERCENT, MIN_WORDS, RULES, STOP_WORDS, VARIED_WORDS


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows: list[tuple]) -> list[tuple]:
    """(row number, root row, links) for rows (id, text): every pair compared."""
    sets = [shingles(text or "") for _, text in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, find(i), links[i]) for i in range(len(rows))]


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    stop = {w for ws in STOP_WORDS.values() for w in ws}
    counts = {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in stop for w in words),
        "n_distinct_words": len(set(words)),
        "n_varied_words": min(n, VARIED_WORDS),
    }
    failed = n < MIN_WORDS or 100 * len(repeated) > MAX_REPEATED_PERCENT * n
    good = all(
        (r.low is None or 100 * counts[r.numerator] >= r.low * counts[r.denominator])
        and (r.high is None or 100 * counts[r.numerator] <= r.high * counts[r.denominator])
        for r in RULES
    )
    return (*list(counts.values())[:5], failed, not failed and good)


def repeats(texts: dict, size: int = 50) -> dict:
    """For each key the starts of word runs of `size` that another text has, too."""
    holders = defaultdict(set)
    for key, text in texts.items():
        words = (text or "").split()
        for i in range(len(words) - size + 1):
            holders[tuple(words[i : i + size])].add(key)
    return {
        key: [
            i
            for i in range(len((text or "").split()) - size + 1)
            if len(holders[tuple((text or "").split()[i : i + size])]) > 1
        ]
        for key, text in texts.items()
    }


def check_packing(rows: list, size: int) -> None:
    """Sequences are gapless from 0, within size, and every piece but a document's last is full."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
