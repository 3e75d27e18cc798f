"""Every operator against a brute-force version, on hard small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rippleframe.llm import bpe, decontam, lines, linking, pii, qda, rules, suffixes, superminhash, toxicity, urls
from rippleframe.llm import queries as registered
from rippleframe.llm.wordbytes import flat, mix
from tests.compare import differences

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def sample(spark, n=120):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") < n).select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def frame(spark, rows):
    """Rows (doc_id, text) with more columns of names that the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("th", "kind", "id", "key", "doc", "label", "score", "size", "start", "n_shingles"):
        df = df.withColumn(name, F.lit("x"))
    return df.select("th", "kind", "id", "text", "key", "doc", "doc_id", "label", "score", "size", "start", "n_shingles")


def empty(spark):
    return frame(spark, [])


def key(doc_id):
    return -1 if doc_id is None or doc_id != doc_id else int(doc_id)


HARD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "a " * 3000), (905, "x" * 20000), (906, "tie tie tie tie tie"), (906, "tie tie tie tie tie"), (None, "a row without an id"), (907, "🙂 é ß " * 40), (908, "1" * 5000)]


# ---- 1


def brute_spans(t):
    forms = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (kind, form) in enumerate(forms):
        for m in re.finditer(form, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PRIVATE = [
    (1, "a@b.c_d@e.f x@y@z.co 1.2.3.4.5.6.7.8 256.1.1.1 0001.0255.03.4 4111 1111 1111 1111 +1 (425) 555-0100 ++1234567890 +1"),
    (2, "é" * 5 + " bob@example.com 🙂 4111111111111111, +44 20 7946 0958."), (3, "x@" + "a." * 3000), (4, "4111-1111-1111-1112 4111-1111-1111-1111"),
    (5, "Agent Zorblax mail q@w.e"), (6, "We met Zorblax mail q@w.e today"), (7, "and Zorblax mail q@w.e again yes"), (8, "so Zorblax wrote q@w.e"),
]


def test_private_spans(spark):
    rows = sample(spark) + PRIVATE + HARD
    got = Counter((key(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.private_spans(frame(spark, rows)).collect())
    expected = Counter()
    for i, t in rows:
        found = brute_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        expected[(key(i), hashlib.sha256(text.encode()).hexdigest(), *(sum(s[3] == k for s in found) for k in ("email", "ip", "card", "phone")))] += 1
    assert got == expected
    assert pii.private_spans(empty(spark)).count() == 0


def test_disclosing_terms(spark):
    df = frame(spark, PRIVATE)
    spans = {r.doc_id: r.spans for r in pii.private_spans(df).collect()}
    assert spans[5] == "term:6:13,email:19:24" or "term:6:13" in spans[5]
    texts = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "q@w.e" not in texts[6] and "[EMAIL]" in texts[6] and "[TERM]" in texts[6]
    # copies of one context are no evidence
    copies = frame(spark, [(k, "Agent Quux mail c@d.e") for k in range(9)])
    assert all("term" not in r.spans for r in pii.private_spans(copies).collect())


def test_disclosure_figures(spark):
    """Shares and information contents against plain counting, at several thresholds."""
    r = random.Random(9)
    words = "alpha bravo delta gamma zorblax quuxer plain other words".split()
    rows = [(k, f"{r.choice(words)} {r.choice(words)} mail m{r.randrange(3)}@x.org {r.choice(words)} {k}" if k % 2 else " ".join(r.choice(words) for _ in range(3))) for k in range(120)]
    docs = frame(spark, rows).select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    near = pii.context_terms(pii.base_spans(docs)).cache()
    seen, contexts, entities = {}, {}, {}
    for x in near.collect():
        seen.setdefault((x.entity, x.term), set()).add(x.doc_id)
        contexts.setdefault((x.entity, x.term), set()).add(x.context)
        entities.setdefault(x.entity, set()).add(x.doc_id)
    having = Counter(w for _, t in rows for w in set(re.split(r"[^a-z]+", t.lower())))
    for least in (0.2, 0.4, 0.6):
        expected = set()
        for (e, t), ids in seen.items():
            content = -np.log2(len(entities[e]) / len(rows))
            if len(contexts[e, t]) >= 3 and content > 0 and 1 + np.log2(min(len(ids) / max(having[t], len(ids)), 1)) / content >= least:
                expected.add((e, t))
        assert {tuple(x) for x in pii.revealing_terms(docs, near, least, 3).collect()} == expected
    near.unpersist()
    assert expected is not None and seen


def test_disclosing_terms_go_everywhere(spark):
    far = "filler words of no account go on and on here. " * 6
    rows = PRIVATE + [(20, f"ZORBLAX 🙂 began. {far}Then Zorblax mail q@w.e now. {far}At last Zorblax left."), (21, "Only Zorblax here")]
    rows += [(100 + k, f"other text {k}") for k in range(400)] + [(21, "Only Zorblax here")]
    spans = [(r.doc_id, r.spans) for r in pii.private_spans(frame(spark, rows)).collect()]
    assert {"term:0:7", "term:298:305", "term:606:613"} <= set(dict(spans)[20].split(",")) and [s for i, s in spans if i == 21] == ["term:5:12"] * 2
    texts = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows)).collect()}
    assert not any("zorblax" in t.lower() for t in texts.values()) and texts[20].startswith("[TERM] 🙂 began.")


# ---- 2


ITEM = "If Tom walks 12 km in 3 hours how far does Tom walk in 7 hours at the same speed?"


def test_template_leaks(spark):
    items = spark.createDataFrame([(1, ITEM), (2, ""), (3, None), (4, "tiny item")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = [(1, ITEM.replace("Tom", "Anna").replace("12", "20").replace(" 3 ", " 4 ")), (2, ITEM.replace("Tom", "Anna", 1).replace("7", "12")), (3, "Intro. " + ITEM + " End."), (4, "IF TOM WALKS ..."), (5, "walks in the park"), (6, "so. tiny item. yes"), (7, "TINY ITEM"), *HARD]
    found = {(key(r.doc_id), r.item_id): r for r in decontam.leaks(frame(spark, rows), items).collect()}
    assert {(1, 1), (3, 1), (7, 4)} <= set(found) and (2, 1) not in found and not any(d >= 900 or d in (4, 5) for d, _ in found)
    assert found[(3, 1)].n_changed == 0 and found[(1, 1)].n_changed > 0
    shuffled = decontam.leaks(frame(spark, rows), items, carried=0)
    assert {(key(r.doc_id), r.item_id) for r in shuffled.collect()} == set(found)
    assert decontam.leaks(empty(spark), items).count() == 0
    assert decontam.contamination(frame(spark, rows), items.limit(0)).filter("contaminated").count() == 0


def test_a_leak_after_a_variant_of_it(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    partial = "If Anna walks 5 km in 2 hours how far is it?"
    table = " ".join(str(k) for k in range(40))
    other = ITEM.replace("Tom", "Anna", 1).replace("7", "12")
    rows = [(1, f"{partial} {ITEM}"), (2, f"{ITEM} {partial}"), (3, f"{table}\n{partial} {partial} and {ITEM}"), (4, f"{partial} {other}")]
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1)} and found[(1, 1)].n_changed == 0


def test_all_pairs_of_texts(spark):
    """The join finds what a plain loop over all pairs finds, whatever stands beside a text in its batch; number lists do not meet by form."""
    r = random.Random(4)
    words = "how many apples does each of the 3 7 12 kg km children Tom Anna Paris buy in days and 5 sell".split()
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(2, 25)))) for k in range(40)] + [(None, "add 3 apples to 4 pears and 5 plums now"), (41, "add 3 apples")]
    items += [(100 + k, " ".join(str(r.randrange(10_000)) for _ in range(30))) for k in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + " " + (items[k % 42][1].replace("3", "9").replace("Tom", "Eve") if k % 3 else "")) for k in range(150)]
    rows += [(500, "add 9 apples"), (501, "add 8 apples to 2 pears and 6 plums now"), (502, " ".join(str(r.randrange(10_000)) for _ in range(2000))), (503, items[60][1]), *HARD]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((key(x.doc_id), key(x.item_id), x.n_found, x.n_windows, x.n_slots, x.n_changed) for x in decontam.leaks(frame(spark, rows), benchmark).collect())
    parsed = [(i, decontam.Text(t, 5)) for i, t in items]
    expected = Counter()
    for i, t in rows:
        doc = decontam.Text(t or "", 5)
        for j, item in parsed:
            found = decontam.leak(doc, item, 80, 10)
            if found:
                expected[(key(i), key(j), *found)] += 1
    assert got == expected and {(500, 41), (501, -1), (503, items[60][0])} <= {x[:2] for x in got} and not any(x[0] == 502 for x in got)
    whole = {key(x.doc_id): x for x in decontam.contamination(frame(spark, rows), benchmark).collect()}
    assert whole[501].contaminated and whole[501].n_items == 1


def test_planted_items_are_found(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = lambda t: re.sub(r"\s+", " ", t).strip()
    texts = {r.item_id: clean(r.text) for r in items.collect()}
    whole = {r.doc_id for r in docs.collect() if any(t in clean(r.text or "") for t in texts.values())}
    caught = {r.doc_id for r in decontam.contamination(docs, items).filter("contaminated").collect()}
    assert whole and whole <= caught


# ---- 3


def test_quality_counts(spark):
    rows = sample(spark) + HARD + [(910, "l one\nl one\n\n\nl one"), (911, "a b c a b c d\x0ba b c")]
    got = Counter(tuple(key(r.doc_id) if k == 0 else v for k, v in enumerate(r[:6])) for r in rules.judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    expected = Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(WORD, t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        count = Counter(windows)
        covered = {j + k for j, g in enumerate(windows) if count[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        expected[(key(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))] += 1
    assert got == expected
    assert rules.judge(empty(spark)).count() == 0


def test_bad_lines_go_and_good_ones_stay(spark):
    good = "\n".join(" ".join(f"w{k}{c}" for c in "abcdefgh") + "." for k in range(12))
    rows = [(1, good), (2, good + "\nHome | About | News | Contact"), (3, "\n".join("WHAT!! A!! SHOUTED!! LINE!! THIS!! ONE%d!! IS!!" % k for k in range(30))), (4, good + "\nAll rights reserved.")]
    out = {r.doc_id: r for r in rules.judge(frame(spark, rows), with_text=True).collect()}
    assert out[1].kept and out[2].kept and not out[3].kept and out[4].kept
    assert out[1].cleaned == good and out[2].cleaned == good + "\n" and out[4].cleaned == good + "\n"


# ---- 4


def test_byte_bpe_round_trip(spark):
    rows = sample(spark) + HARD
    path = bpe.vocabulary_path()
    encoding = bpe.codec(path)[0]
    expected = Counter()
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expected[(key(i), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    for cut in (64, bpe.CUT_CHARS):
        assert Counter((key(r.doc_id), *r[1:]) for r in bpe.token_digests(frame(spark, rows), cut_chars=cut).collect()) == expected
    back = bpe.decode(bpe.encode(frame(spark, rows)))
    assert Counter(bytes(r.raw) for r in back.collect()) == Counter((t or "").encode() for _, t in rows)
    assert bpe.token_digests(empty(spark)).count() == 0


# ---- 5


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1) if i is not None else ():
            first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1) if i is not None else ():
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[(key(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("text", "per_slot"), [(suffixes.PIECE_TEXT, suffixes.PIECES_A_SLOT), (3000, 1)])
def test_repeated_strings(spark, monkeypatch, text, per_slot):
    monkeypatch.setattr(suffixes, "PIECE_TEXT", text)
    monkeypatch.setattr(suffixes, "PIECES_A_SLOT", per_slot)
    p = "The quick brown fox jumps over the lazy dog again and again, é" + "abc" * 30
    rows = sample(spark, 60) + HARD + [(1001, p), (1002, "pre " + p[5:] + " post"), (1003, "a" * 300), (1004, "a" * 50), (1005, "b" + "a" * 60), (1006, p[:50]), (1007, p[:49]), (1002, "pre " + p[5:] + " post")]
    got = Counter((key(r.doc_id), *r[1:]) for r in suffixes.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_every_place_of_a_repeat_in_one_document(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = []
    for k in range(12):
        line, block = word(120), word(90)
        rows += [(10 * k + 1, line), (10 * k + 2, word(20) + line * 4 + word(20))]
        rows += [(10 * k + 3, word(30) + block[:70] + word(30)), (10 * k + 4, block + word(40) + block + word(25))]
    got = Counter((key(x.doc_id), *x[1:]) for x in suffixes.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_suffixes_of_a_long_text(monkeypatch):
    """Ranking and hashing in parts leave out no window and change no result."""
    r = random.Random(3)
    words = ["".join(r.choice("abcde ") for _ in range(r.randrange(3, 90))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 300, 1, 40, 500, 2, 3)]
    ids, texts = pa.array([4, 9, 1, None, 5, 6, 6]), pa.array(texts)
    data, offsets = flat(texts)
    live = np.array([True, True, True, False, True, True, True])

    def result():
        answers = []
        for level in range(4):
            b = suffixes.Piece(ids, texts, answers, 1, 50, 20).refine(level)[0]
            firsts = pa.array([b.first.tolist() if level in (suffixes.STRETCH, suffixes.WINDOW) else None], pa.list_(pa.int64()))
            keys = (b.keys & ~np.uint64(1) | b.several.astype(np.uint64)).view(np.int64)
            answers += [x | {"level": level} for x in suffixes._sorted_buckets(pa.table({"piece": [0], "slot": [0], "keys": [keys.tolist()], "firsts": firsts})).to_pylist()]
        _, starts, ends = suffixes.Piece(ids, texts, answers, 1, 50, 20).refine(4)
        return {k for a, b in zip(starts, ends, strict=True) for k in range(a, b)}

    whole = result()
    for part in (64, 200, 1000):
        monkeypatch.setattr(suffixes, "RANKED", part)
        monkeypatch.setattr(suffixes, "HASHED", part)
        _, at, low, n, doc = suffixes.anchors(data, offsets, live)
        covered = np.concatenate([np.arange(a, a + c) for a, c in zip(low, n, strict=True)])
        every = [k for d in range(7) if live[d] for k in range(offsets[d], offsets[d + 1] - 49)]
        assert sorted(covered) == every and (offsets[doc] <= low).all() and (at - low >= n - 1).all() and (at - low <= 30).all()
        assert result() == whole
    first = {}
    for d, i in enumerate(ids.to_pylist()):
        for k in range(offsets[d], offsets[d + 1] - 49) if i else ():
            first[bytes(data[k : k + 50])] = min(first.get(bytes(data[k : k + 50]), i), i)
    assert whole == {k + x for d, i in enumerate(ids.to_pylist()) for k in (range(offsets[d], offsets[d + 1] - 49) if i else ()) if first[bytes(data[k : k + 50])] < i for x in range(50)}


# ---- 6, 8


def test_toxicity_learns_words(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [r.choice(vocabulary) for _ in range(60)]
        if bad:
            words[r.randrange(60)] = r.choice(["vile", "nasty"])
            words[r.randrange(60)] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(frame(spark, rows + HARD), labels).collect()
    truth = dict(marks)
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert len(held) > 60 and all(x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in out)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert len(out) == len(rows + HARD)
    none = toxicity.toxicity(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_toxicity_learns_repeated_ids_once(spark):
    rows = [(i, "vile words here" if i % 3 == 0 else "calm words here") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once = {(x.place, x.weight) for x in toxicity.trained(frame(spark, rows), labels).collect()}
    again = toxicity.trained(frame(spark, rows + [(0, "vile words here")] * 50 + [(0, "zz larger text")]), labels).collect()
    assert once and once == {(x.place, x.weight) for x in again}


def test_ftrl_against_a_scalar_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 4)
    monkeypatch.setattr(toxicity, "L1", 0.3)
    r = random.Random(6)
    rows = [(np.array(sorted(r.sample(range(16), r.randint(0, 6))), np.int64), r.randint(0, 1)) for _ in range(80)]
    z, n, bias = [0.0] * 17, [0.0] * 17, 16

    def weight(i):
        push = max(abs(z[i]) - (0 if i == bias else toxicity.L1), 0)
        return (-push if z[i] > 0 else push) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for places, label in rows:
            at = [*places.tolist(), bias]
            w = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-sum(w))) - label
            for i, x in zip(at, w, strict=True):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * x
                n[i] += g * g
    assert np.allclose(toxicity.fit(rows), [weight(i) for i in range(17)]) and any(weight(i) == 0 for i in range(16))


def test_quality_separates_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = qda.quality(docs, labels).collect()
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    some = qda.quality(frame(spark, HARD), labels.limit(0)).collect()
    assert len(some) == len(HARD) and {x.score for x in some} == {0.5}
    assert qda.quality(empty(spark), labels).count() == 0


def test_quadratic_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(0)
    k = len(qda.NAMES)
    moments = {c: (100.0 + c, rng.normal(size=k), (lambda a: a @ a.T + np.eye(k))(rng.normal(size=(k, k)))) for c in (0, 1)}
    model = qda.Discriminant(moments, shrinkage=0.0)
    x = rng.normal(size=(5, k))
    logs = []
    for c in (0, 1):
        n, mean, cov = moments[c]
        cov = cov + 1e-6 * np.eye(k)
        d = x - mean
        logs.append(np.log(n / 201) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -35, 35))))


# ---- 7


def plain_edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance():
    r = random.Random(1)
    for _ in range(3000):
        a, b = (bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(2))
        for k in range(4):
            assert lines.within(a, b, k) == (plain_edits(a, b) <= k)


def test_many_banded_distances(monkeypatch):
    monkeypatch.setattr(lines, "CELLS", 400)
    monkeypatch.setattr(lines, "FEW", 3)
    r = random.Random(8)
    pairs = [tuple("".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in range(2)) for _ in range(400)]
    edits = np.array([r.randint(0, 4) for _ in pairs])
    side = lambda k: (np.array([ord(c) for p in pairs for c in p[k]], np.uint32), np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]))
    assert lines.all_within(side(0), side(1), edits).tolist() == [plain_edits(*p) <= e for p, e in zip(pairs, edits, strict=True)]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    r = random.Random(edits)
    base = "the quick brown fox jumps over it"

    def changed(s, k):
        s = list(s)
        for _ in range(k):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([["x"], ["y", s[i]], []])
        return "".join(s)

    rows = [(i, "\n".join(changed(base, r.randint(0, 3)) if r.random() < 0.5 else "".join(r.choice("abcdef ") for _ in range(r.randint(3, 40))) for _ in range(4))) for i in range(40)]
    rows += HARD + [(60, "only line here that is long"), (61, "only line here that is long"), (None, "only line here that is long"), (61, "only line here that is long")]
    every = sorted({(i, n, x) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if re.search(WORD, x)})
    up = list(range(len(every)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(every)):
        for j in range(i):
            x, y = every[i][2], every[j][2]
            if x == y or abs(len(x) - len(y)) <= edits < min(len(x), len(y)) < 200 and plain_edits(x, y) <= edits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    gone = {every[i][:2] for i in range(len(every)) if top(i) != i}
    expected = Counter((key(i), "\n".join(x for n, x in enumerate((t or "").split("\n")) if i is None or (i, n) not in gone)) for i, t in rows)
    assert Counter((key(x.doc_id), x.text) for x in lines.dedup_lines(frame(spark, rows), edits=edits).collect()) == expected
    assert lines.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [lines.CROWD, 0, 3])
def test_near_lines_by_length(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines.line_classes, "__defaults__", (crowd,))
    r = random.Random(11)
    words = ["straße", "ordinary", "maße", "little", "日本語", "of", "paragraphs", "walk", "zürich", "near"]
    sentence = lambda n: "".join(r.choice(words) + " " for _ in range(n))[: r.randint(12, 8 * n)]

    def changed(s, k):
        s = list(s)
        for _ in range(k):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([["é"], ["y", s[i]], [], [s[i], "語"]])
        return "".join(s)

    every = []
    for _ in range(40):
        s = sentence(r.randint(3, 32))
        every += [s, *(changed(s, r.randint(0, 9)) for _ in range(3))]
    every += ["ab" * k for k in range(30, 45)] + ["a " * k for k in range(30, 45)]  # fewer different grams than edits spoil
    every = list(dict.fromkeys(every))
    up = list(range(len(every)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(every)):
        for j in range(i):
            most = min(min(len(every[i]), len(every[j])) // 12, 8)
            if abs(len(every[i]) - len(every[j])) <= most and plain_edits(every[i], every[j]) <= most:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(frame(spark, list(enumerate(every)))).collect()}
    assert got == {i: int(top(i) != i) for i in range(len(every))} and 30 < sum(got.values())


def test_many_lines_with_one_half(spark):
    r = random.Random(2)
    half = "2026-11-28 07:01:57 INFO one.long.name.of.a.service.that.writes.every.line "
    body = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70))
    texts = [half + body() for _ in range(20_000)]
    texts += [x[:90] + "é" + x[91:] for x in texts[:50]]
    docs = spark.createDataFrame([(i, "\n".join(texts[k : k + 50])) for i, k in enumerate(range(0, len(texts), 50))], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(docs).collect()}
    assert got.pop(400) == 50 and set(got.values()) == {0}


def test_short_lines_repeat_too(spark):
    rows = [(1, "Menu\n\nan ordinary line of text\n \n日本語"), (2, "Menu\n\n日本語\n \nMenus"), (3, "Menu\nMenu")]
    got = {x.doc_id: (x.n_removed, x.text) for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "\n \nMenus"), 3: (2, "")}


# ---- 9


def test_urls(spark):
    out = registered.QUERIES["op9_url_automaton"](spark, SF)
    assert not differences(out, registered.ORACLE_SQL["op9_url_automaton"], SF)
    hard = [(1, None), (2, ""), (3, "nothing"), (4, "http://EXAMPLE.org/en/1x?q"), (5, "x://a.example.org"), (6, "http://h.net/x.example.org/es/"), (7, "http://a.spam-b.net/" + "y" * 5000), (8, "http://com/fr/"), (8, "http://com/fr/")]
    df = spark.createDataFrame(hard, "page_id long, url string").withColumn("rule", F.lit("r")).withColumn("host", F.lit("h"))
    got = {r.page_id: (r.rule, r.verdict, r.host) for r in urls.filter_urls(df).collect()}
    assert got[1] == got[2] == got[3] == (None, "allow", "")
    assert got[4] == ("example.org/en/1", "block", "example.org") and got[5] == (None, "allow", "a.example.org")
    assert got[6] == (None, "allow", "h.net") and got[7][1] == "block" and got[8] == ("com/fr/", "allow", "com")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_automaton_against_patterns():
    r = random.Random(2)
    globs = tuple("".join(r.choice(["a", "b", "*", "**", "/", "ab"]) for _ in range(r.randint(1, 6))).replace("***", "**").replace("***", "**") for _ in range(60))
    texts = ["".join(r.choice("ab/") for _ in range(r.randint(0, 9))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = urls.Automaton.of(globs).matches(data, offsets)
    for k, glob in enumerate(globs):
        form = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", glob))
        assert [bool(x) for x in got[:, k]] == [re.fullmatch(form, t) is not None for t in texts], glob


# ---- 10


def plain_signature(elements, places):
    out = np.full(places, np.inf)
    for e in elements:
        p = list(range(places))
        for j in range(places):
            h = mix(np.array([e], np.uint64) ^ np.uint64((j + 1) * superminhash._LEVEL % (1 << 64)))
            k = j + int(((mix(h) >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32))[0])
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j + float((h >> np.uint64(11))[0]) * 2.0**-53)
    return out


def test_signature_stops_early_without_a_change():
    e = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [1, 9, 30])
    got = superminhash.signatures(e, doc, 4, 32)
    for d in range(3):
        assert got[d] == pytest.approx(plain_signature(e[doc == d], 32))
    assert np.isinf(got[3]).all()


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    r = random.Random(words)
    base = [f"b{k}" for k in range(60)]
    family = [(2000 + i, " ".join(w if r.random() > 0.01 * (i % 8) else f"e{i}_{k}" for k, w in enumerate(base))) for i in range(150)]
    rows = sample(spark, 200) + family + [(i + 5000, t) for i, t in family[:20]] + HARD
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        both = Counter(j for s in sets[i] for j in holders[s] if j > i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    for x in superminhash.near_duplicates(frame(spark, rows), words=words).collect():
        i = None if x.doc_id is None else x.doc_id
        assert x.n_shingles == len(sets[i])
        assert (x.component_id, x.kept) == ((top(i), top(i) == i) if i is not None else (None, True))
    assert superminhash.near_duplicates(empty(spark)).count() == 0


def test_parity_sketch_is_a_bound():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    a, b = e[:400], e[100:]
    s = superminhash.parity_sketches(np.concatenate([a, b]), np.repeat([0, 1], 400), 2).view(np.uint64)
    assert 0 < sum(bin(int(x)).count("1") for x in s[0] ^ s[1]) <= 200


@pytest.mark.parametrize("most", [10**6, 0])
def test_components_of_chains(spark, most):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(101, 100), (100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in linking.components(links, most).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert linking.components(links.limit(0), most).count() == 0


def test_components_of_one_task_and_of_rounds(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    known = spark.createDataFrame([(f"\u00e9{a}" if a % 7 == 0 else f"z{a}", f"\u00e9{b}" if b % 7 == 0 else f"z{b}") for a, b in links], "a string, b string")
    one, rounds = ({r.id: r.label for r in linking.components(known, most).collect()} for most in (10**6, 0))
    assert one == rounds and len(set(one.values())) > 5
