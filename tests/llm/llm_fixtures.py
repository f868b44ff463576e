"""Texts and rows for the tests of this folder."""

import random

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

# names that operators use for columns of their own
CLASHING = "n_tokens kept score key row spans words path text_id statistics target _row _n _words first copied single a.b c`d".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "a"]
    syllables = "an er ti on he th in re nd ha es st en".split()

    def word():
        return r.choice(common) if r.random() < 0.3 else "".join(r.choices(syllables, k=r.randint(1, 4)))

    return " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    shared = prose(2, 60)
    texts = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, "  \n \t "),
        (None, prose(3, 40)),
        (None, base),
        (7, prose(4, 30)),
        (7, prose(4, 30)),
        (7, prose(5, 30)),
        (8, prose(6, 30_000)),
        (9, f"{prose(7, 30)} {shared} {prose(8, 30)}"),
        (10, f"{prose(9, 10)}\n{shared}\n{prose(10, 45)}"),
        (11, "a b c"),
        (12, "a b c"),
        (13, "naïve ÀÉ İstanbul ΑΣ 日本語 😀 <|endoftext|> <s> ▁x\x1cy  two  spaces\r\n\t'LL can't 12345 é"),
        (14, "!!! ??? 123"),
        (15, " ".join(["same"] * 60)),
    ]
    return [(i, t, "en" if (i or 0) % 5 else None, None if (i or 0) % 7 == 3 else "s", len(t or "")) for i, t in texts]


def plain(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
