"""Operator 2 against a version written apart from it: words, templates and windows as plain tuples, no hashes, no joins."""

import random
import re

from rippleframe.llm import decontam
from tests.llm.test_operators import HARD, frame, key

#: Some of the words that count as units after a number.
UNITS = {"km", "kg", "days", "hours", "m", "min"}
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)


def words_of(text):
    """(form, value) of each word; the form of a number, unit or name is its kind."""
    out, before = [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word, digit = m[0], re.search("[0-9]", m[0])
        number = bool(digit) and not re.search(r"[^0-9.,:/%+\-$()€£]", word)
        inner = re.sub(f"^[{re.escape(OUTER)}]{{0,3}}", "", word)
        inner = re.sub(f"[{re.escape(OUTER)}]{{0,3}}$", "", inner)
        first = before is None or before[0][-1] in ".!?" or "\n" in text[before[1] : m.start()]
        if number:
            kind = "<number>"
        elif out and out[-1][0] == "<number>" and lower(inner) in UNITS:
            kind = "<unit>"
        elif not first and not digit and re.match("[A-Z][a-z]", inner):
            kind = "<name>"
        else:
            kind = None
        out.append((kind or lower(inner), lower(inner), kind))
        before = (word, m.end())
    return out


def windows_of(words, k=5):
    k = min(k, len(words))
    shown = lambda part: tuple(w[1] for w in part) if all(w[2] for w in part) else tuple(w[0] for w in part)
    return [(k if k < 5 else 5, shown(words[i : i + k])) for i in range(len(words) - k + 1)] if k else []


def one_to_one(pairs):
    """Slots that break the best mapping, counted like values with a second partner."""
    broken = 0
    for side in (0, 1):
        partners = {}
        for p in pairs:
            partners.setdefault(p[side], set()).add(p[1 - side])
        broken = max(broken, sum(len(v) - 1 for v in partners.values()))
    return broken


def in_one_place(doc, item):
    """Whether the item stands in the document word for word, forms and slots, at some place."""
    for at in range(len(doc) - len(item) + 1):
        here = doc[at : at + len(item)]
        if all(a[0] == b[0] for a, b in zip(here, item, strict=True)):
            slots = [(b[1], a[1]) for a, b in zip(here, item, strict=True) if a[2]]
            if 100 * one_to_one(slots) <= 10 * len(slots) and set(windows_of(item)) <= set(windows_of(doc)):
                return True
    return False


def test_leaks_lie_between_two_plain_conditions(spark):
    rng = random.Random(12)
    plain = "how many apples does each child buy in the small shop near a river before noon and why".split()
    item = lambda: " ".join(rng.choice([*plain, str(rng.randint(2, 99)), f"{rng.randint(2, 9)} km", "Tom", "Anna", "Paris"]) for _ in range(rng.randint(5, 22)))
    items = [(k, item() + rng.choice("?.")) for k in range(60)]
    rows = []
    for k in range(240):
        text = items[k % 60][1]
        if k % 4 == 1:
            text = text.replace("Tom", "Eve").replace("Anna", "Rosa").replace("km", "kg")
        if k % 4 == 2:
            text = re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 1), text)
        if k % 4 == 3:  # a few words changed
            text = " ".join(rng.choice(plain) if rng.random() < 0.15 else w for w in text.split())
        rows.append((k, f"{' '.join(rng.choice(plain) for _ in range(rng.randint(0, 30)))}. Then {text} {' '.join(rng.choice(plain) for _ in range(rng.randint(0, 9)))}"))
    found = {(key(r.doc_id), r.item_id): (r.n_found, r.n_windows) for r in decontam.leaks(frame(spark, rows + HARD), spark.createDataFrame(items, "item_id long, text string")).collect()}
    parsed = [(j, words_of(t)) for j, t in items]
    must, kinds = 0, set()
    for i, text in rows:
        doc = words_of(text)
        own = set(windows_of(doc))
        for j, words in parsed:
            wanted = set(windows_of(words))
            enough = 100 * len(wanted & own) >= 80 * len(wanted)
            if (i, j) in found:
                assert enough and found[i, j] == (len(wanted & own), len(wanted))
                kinds.add(i % 4)
            elif enough:
                assert not in_one_place(doc, words), (text, items[j])
            must += enough and in_one_place(doc, words)
    assert must > 60 and {0, 1, 2} <= kinds and not any(d >= 900 for d, _ in found)
