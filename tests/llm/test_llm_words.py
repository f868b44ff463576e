"""Spelling variants, conversation repair and toxicity against brute force, edge cases and held-out labels."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import MEDIUM, plain
from pyspark.sql import functions as F

from tallybook.llm import conversation_repair, spelling_variants, toxicity
from tallybook.llm.batches import read

# ---- spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, damage):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def variant_rows(seed: int):
    r = random.Random(seed)
    stems = ["Étagère", "thereby", "cottage", "aabbaab", "strasse", "Straße", "ÀÉÎÕÜ", "banana", "xylophone" * 8]
    words = list(stems)
    for w in stems:
        for _ in range(8):
            i = r.randrange(len(w))
            words += [w[:i] + w[i + 1 :], w[:i] + r.choice("abcéß") + w[i:], w[:i] + r.choice("abcéß") + w[i + 1 :]]
            words.append("".join(r.sample(w, len(w))))
    rows = [(i if i % 9 else None, " ".join(r.choices(words, k=60)) + r.choice(["", "×÷", "\n12ab_cd"])) for i in range(60)]
    return rows + [(3, rows[3][1]), (99, None), (98, ""), (97, "the tiny word aa aaa aaaa")]


@pytest.mark.parametrize("damage", [None, 7])
def test_variants_equal_brute_force(spark, damage):
    rows = variant_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("word", F.lit("clash"))
    got = spelling_variants.variants(docs, damage).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = brute_variants(rows, damage)
    assert len(expected) > 100 and sum(1 for e in expected if e[1]) > 20
    assert plain(got) == plain(expected)


def test_every_near_pair_shares_a_signature():
    r = random.Random(5)
    for _ in range(300):
        length = r.randint(5, 14)
        w = "".join(r.choices("aeinrtséß", k=length))
        i = r.randrange(length)
        for v in (w[:i] + r.choice("aeinxé") + w[i + 1 :], w[:i] + r.choice("aeinxé") + w[i:]):
            if v == w:
                continue
            keys = []
            for x in (w, v):
                letters = np.frombuffer(x.encode("latin-1"), np.uint8).reshape(1, -1)
                keys.append({(role, int(k[0])) for role, k in spelling_variants._signatures(letters)})
            wanted = {(role if len(v) == len(w) else 2, k) for role, k in keys[0] if role == (0 if len(v) == len(w) else 1)}
            assert wanted & keys[1], (w, v)


def test_no_documents_have_no_variants(nothing, edge):
    assert spelling_variants.variants(nothing).collect() == []
    assert spelling_variants.variants(edge, 97).count() > 10


def test_respelling_uses_roots(spark):
    docs = spark.createDataFrame([(1, "Cotage, cottage!\nx"), (2, None), (3, "")], "doc_id long, text string")
    found = spark.createDataFrame([("cotage", "cottage"), ("cottage", "cottage")], "word string, root string")
    got = {r.doc_id: r.text for r in spelling_variants.respelled(docs, found).collect()}
    assert got == {1: "cottage, cottage!\nx", 2: None, 3: ""}


# ---- conversation repair

SYMBOLS = "suaoSUAOx"


def brute_repair(signature: str) -> tuple[int, str]:
    """Cheapest edits over all target strings, by the plain recursion on rows and grammar states."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {}

    def search(i, state, inserted):
        if (i, state, inserted) in best:
            return best[i, state, inserted]
        found = [(0, "")] if i == len(signature) and state in (0, 3) else []
        if inserted < 2:
            for role, to in follow[state].items():
                if role in "ua":
                    c, a = search(i, to, inserted + 1)
                    found.append((c + 5, "I" + a))
        if i < len(signature):
            symbol = signature[i]
            c, a = search(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            if symbol != "x":
                late = 5 if symbol.isupper() else 0
                for role, to in follow[state].items():
                    c, a = search(i + 1, to, 0)
                    if role == symbol.lower():
                        found.append((c + late, "K" + a))
                    elif role in "ua":
                        found.append((c + late + 1, "R" + a))
        best[i, state, inserted] = min(found, default=(math.inf, ""))
        return best[i, state, inserted]

    return search(0, 0, 0)


def test_repairs_equal_brute_force():
    automaton = conversation_repair.Suffixes()
    short = ["".join(s) for n in range(5) for s in itertools.product(SYMBOLS, repeat=n)]
    r = random.Random(3)
    long = ["".join(r.choices("suaoUAx", weights=[1, 6, 6, 1, 1, 1, 2], k=r.randint(5, 30))) for _ in range(300)]
    for backwards in sorted(s[::-1] for s in short + long):
        assert automaton.solve(backwards) == brute_repair(backwards[::-1]), backwards[::-1]


def test_repairs_across_tasks(spark):
    r = random.Random(4)
    texts = list({"".join(r.choices(SYMBOLS, k=r.randint(0, 12))) for _ in range(400)})
    got = conversation_repair.solve(spark.createDataFrame([(t,) for t in texts], "signature string").repartition(5))
    assert {x.signature: (x.cost, x.audit) for x in got.collect()} == {t: brute_repair(t) for t in texts}


TALKS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."),
    (2, 0, "user", "One."), (2, 1, "user", "Two."), (2, 2, "assistant", "cut"), (2, 4, "assistant", "End."),
    (3, 5, "tool", "x."), (3, 5, "tool", "x."), (3, 6, None, None), (3, 7, "", "no role."),
    (4, None, "assistant", "late."), (4, 1, "user", "early."), (4, None, "assistant", "again."),
    (None, 0, "user", "Who?"), (None, 1, "assistant", "Nobody!\n \t"),
    (5, 9, "user", " \x0b "), (6, None, "user", "only."), (7, 1, "user", "é" * 200_000 + "."),
]


def talks(spark, rows=TALKS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return df.withColumns({c: F.lit("clash") for c in ("key", "digest", "audit", "signature", "place", "row")})


def brute_talk(rows):
    """Figures, audit and repaired lines of one conversation, rows in any order."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
    seen, signature, faults, roles = set(), "", Counter(), ""
    for _, role, text in rows:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        roles += initial
        signature += "x" if fault in ("b", "d") else initial.upper() if fault else initial
    cost, audit = brute_repair(signature)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(1 for p in zip(roles, roles[1:]) if "".join(p) not in ("su", "ua", "au"))
    lines, state, queue = [], 0, list(rows)
    for edit in audit:
        wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        if edit == "I":
            lines.append(f"{wanted}:")
        else:
            _, role, text = queue.pop(0)
            if edit == "D":
                continue
            if edit == "K" and role[0] == "s":
                wanted, state = role, 0
                lines.append(f"{role}:{text}")
                state = 1
                continue
            lines.append(f"{role if edit == 'K' else wanted}:{text}")
        state = 3 if state == 2 else 2
    return gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, lines


def test_conversations_are_repaired(spark):
    given = talks(spark)
    by_id = defaultdict(list)
    for c, *row in TALKS:
        by_id[c].append(tuple(row))
    expected = {c: brute_talk(rows) for c, rows in by_id.items()}
    audited = conversation_repair.audits(given)
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    assert {r.conv_id: tuple(r[f] for f in figures) for r in audited.collect()} == {c: e[:7] for c, e in expected.items()}
    lines = defaultdict(list)
    for r in conversation_repair.repair(given).collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert dict(lines) == {c: e[7] for c, e in expected.items() if e[7]}
    roles = {c: "".join(line[0] for line in got) for c, got in lines.items()}
    assert all(r.lstrip("s") == "ua" * (len(r.lstrip("s")) // 2) for r in roles.values())


def test_damage_and_digests(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. of {c}!") for c in range(40) for t in range(6)]
    rows += [(None, 0, "user", None), (41, 3, None, "x.")]
    by_id = defaultdict(list)
    for c, t, role, text in rows:
        by_id[c] = by_id[c]
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{t}".encode()) % 20
        if d == 0:
            continue
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(d, text)
        by_id[c] += [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    got = {r.conv_id: r for r in conversation_repair.repair_digests(talks(spark, rows)).collect()}
    assert got.keys() == by_id.keys()
    for c, kept in by_id.items():
        e = brute_talk(kept)
        assert tuple(got[c])[1:8] == e[:7]
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(e[7]).encode()).hexdigest()


def test_no_conversations(spark):
    none = talks(spark).filter("false")
    assert conversation_repair.repair_digests(none).collect() == []
    assert conversation_repair.repair(none).collect() == []


# ---- toxicity


def brute_reading(token, costs):
    """The cheapest of all paths through the lattice, each written out."""
    ways = toxicity.lattice(token)

    def paths(i):
        if i == len(token):
            yield "", 0.0
            return
        for to, read, price in ways[i]:
            for rest, cost in paths(to):
                yield read + rest, price + cost

    def letters(text):
        total, a, b = 0.0, 0, 0
        for c in text + " ":
            k = toxicity._NUMBER.get(c, 0)
            a = a if b else 0
            if k or b:
                total += costs[a][b][k]
            a, b = b, k
        return total

    return min(((cost + letters(text), text) for text, cost in paths(0)))


def test_readings_are_the_cheapest_paths():
    r = random.Random(2)
    costs = toxicity.letter_costs(np.array([r.random() ** 8 * 1000 for _ in range(toxicity.SIZE**3)]))
    decoder = toxicity.Decoder(costs)
    for _ in range(150):
        token = "".join(r.choices("ab10e$$. -aé3", k=r.randint(1, 9)))
        cost, text = brute_reading(token, costs)
        assert decoder.read(token) == text.split(), token


def test_letters_are_counted_over_slices(spark):
    texts = ["Ab abé", None, "", "ab-ab ÀB\n" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = toxicity.count_letters(docs)
    n = toxicity._NUMBER
    at = lambda a, b, c: counts[(a * toxicity.SIZE + b) * toxicity.SIZE + c]
    assert at(0, 0, n["a"]) == 2 + 100 and at(0, n["a"], n["b"]) == 2 + 100
    assert at(n["a"], n["b"], n["é"]) == 1 and at(n["a"], n["b"], 0) == 1 + 100 and at(0, n["à"], n["b"]) == 50
    pieces = np.concatenate(list(toxicity._cells("x" * ((1 << 20) + 5))))
    assert len(pieces) == (1 << 20) + 5


@pytest.fixture(scope="module")
def disguised(spark):
    """Texts of common words, a fifth with two of ten bad ones; the last hundred show them in disguise."""
    r = random.Random(9)
    common = ["house", "river", "walking", "stone", "garden", "window", "letter", "music", "table", "green", "quiet"]
    bad = ["grobnik", "flurzat", "mixelop", "drastwen"]
    rows = []
    for i in range(800):
        words, toxic = r.choices(common, k=30), i % 5 == 0
        for _ in range(2 if toxic else 0):
            words[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    hide = ["gr0bnik and m1xel0p", "f-l-u-r-z-a-t or g r o b n i k", "drrrrastwen, mixxxxelop", "dr@$twen fl.ur.zat"]
    hidden = [(1000 + i, " ".join(r.choices(common, k=20)) + " " + hide[i % 4], 1) for i in range(40)]
    df = spark.createDataFrame(rows + hidden, "doc_id long, text string, toxic int").repartition(4)
    return df, {i for i, _, _ in hidden}


def test_disguised_words_are_found(disguised):
    df, hidden = disguised
    labels = df.filter("doc_id < 1000").select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.classify(df.drop("toxic"), labels).collect()}
    assert len(got) == 840
    assert sum(got[i].predicted for i in hidden) >= 38
    assert sum(got[i].predicted for i in range(800) if i % 5) == 0
    assert all(got[i].predicted for i in range(0, 800, 5))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)


def test_texts_are_restored(disguised):
    df, hidden = disguised
    restored = {r.doc_id: r.restored for r in toxicity.restore_texts(df.drop("toxic")).collect()}
    assert sum("grobnik and mixelop" in restored[i] for i in hidden) == 10
    assert all(restored[r.doc_id] == r.text for r in df.filter("doc_id < 800").collect())


def test_evidence_of_texts_reads_only_tokens_that_may_hide_something():
    r = random.Random(4)
    costs = toxicity.letter_costs(np.zeros(toxicity.SIZE**3, np.int64)).astype(np.float32)
    known = {"bad": 2.0, "badl*": 1.5, "badly": 1.5, "wors*": 1.0, "\u00e9vil": 0.5, "fine": -1.0}
    model = toxicity.Model(costs, known, 1.0, 0.0)
    words = ["bad", "badly", "badland", "worst,", "\u00c9vil!", "b4d", "baaad", "ba.d", "(bad)", "fine", "other.", "b a d", "\u00f7", "\u03a3", "\n"]
    texts = ["", " "] + [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(500)]
    of_texts, one = toxicity.Evidence(model), toxicity.Tokens(toxicity.Reader(costs), model.of_word)
    assert of_texts(texts) == [toxicity._strongest(one(t)) for t in texts]
    assert not {"bad", "badly", "worst,", "other."} & set(of_texts.tokens.known)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = read(spark, MEDIUM.replace("0.01", "0.1"), "documents"), read(spark, MEDIUM.replace("0.01", "0.1"), "labels")
    scored = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in scored if r.toxic], [r for r in scored if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic) and len(toxic) > 50
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_of_edge_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.classify(edge, labels.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(nothing, labels).collect() == []
    unlabelled = toxicity.classify(edge, labels.filter("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}
