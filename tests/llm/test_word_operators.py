"""Filter audit, decontamination and spelling variants against plain versions, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerspark.llm import filter_audit, spelling, winnowing

from .llm_cases import EDGES, prose

ITEM = "item_id long, text string, w0 string, item string, words string, span int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- filter interaction audit


@given(st.lists(st.text(st.sampled_from("aB é　#\t\n\x0b\U0001f600"), max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_transducer_counts_what_regexes_count(texts):
    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), bool(re.search("[#$%&*|]", t))

    assert filter_audit.count_texts([t.encode() for t in texts]) == [plain(t) for t in texts]


def plain_audit(rows, labels):
    """Every order applied to every document in turn."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    fails, first = [], {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        fails.append((lang or "", failed, i in good, i in bad))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, start=1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f[1][name] and any(f[1][x] for x in order[: step - 1]) for f in own),
                    sum(f[1][name] and sum(f[1].values()) == 1 for f in own),
                    sum(f[2] for f in gone),
                    sum(f[3] for f in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_all_orders_against_a_plain_audit(spark, docs):
    many = prose(5, 220)
    cases = [*[(i, t, ["en", None, "", "fr"][(i or 0) % 4]) for i, t in EDGES]]
    cases += [(20, many, "en"), (21, many, "fr"), (22, many + " #", "en"), (None, many, "en"), (23, "A" * 50 + many, "en"), (24, "x " * 300, "en")]
    marks = [(1, 1, 0), (20, 1, 1), (21, 0, 1), (22, 1, None), (None, 1, 1), (24, None, 1), (24, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS failed", "2 AS good")
    clash = docs(*cases).selectExpr("*", "'x' AS part", "1 AS failed", "1 AS text_sha", "1 AS first_id", "1 AS n", "1 AS n_words")
    got = filter_audit.audit(clash, labels).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got) and found == plain_audit(cases, marks)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs((1, "a")).limit(0), labels).count() == 0
    assert filter_audit.audit(docs((1, None)), labels).where("good_lost > 0 OR toxic_lost > 0").count() == 0


# --- benchmark decontamination


def plain_hits(text, items):
    """Words in any window of any item, all windows held against all places."""
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, names = set(), set()
    for name, item in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        size = min(10, len(words))
        windows = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if size else set()
        for at in range(len(own) - size + 1):
            if size and tuple(own[at : at + size]) in windows:
                hit |= set(range(at, at + size))
                names.add("" if name is None else str(name))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def held_against_plain(spark, docs, cases, items):
    bench = spark.createDataFrame([(i, t, "x", "x", "x", 1) for i, t in items], ITEM)
    clash = docs(*cases).selectExpr("*", "'x' AS words", "1 AS mark", "1 AS marks", "'x' AS items", "1 AS hash", "'x' AS of_id", "1 AS c1", "1 AS start")
    got = winnowing.digest(winnowing.decontaminate(clash, bench)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *plain_hits(t, items)) for i, t in cases), key=repr)


def test_planted_passages_of_every_length(spark, docs):
    own = random.Random(7)
    items = [(k, prose(100 + k, own.choice([1, 2, 3, 5, 6, 7, 9, 10, 11, 15, 40]), "abc")) for k in range(25)]
    items += [(None, prose(300, 12)), (3, prose(301, 14)), (26, None), (27, ""), (28, " .,;"), (29, "É and É, and café ÀB c d e f g h"), (30, prose(302, 3000))]
    cases = list(EDGES)
    for k in range(60):
        item = own.choice(items)[1] or ""
        words = item.split()
        a = own.randint(0, max(0, len(words) - 1))
        piece = " ".join(words[a : a + own.randint(1, 20)])
        cases.append((100 + k, f"{prose(400 + k, 30)} {piece.upper() if k % 2 else piece}. {prose(500 + k, 20)}"))
    cases += [(200, "a " * 50), (201, (items[-1][1] + " ") * 2), (202, items[-1][1][:-9])]
    held_against_plain(spark, docs, cases, items)


def test_only_long_items_and_hot_passages(spark, docs):
    shared = prose(1, 30)
    items = [(k, f"{prose(k + 10, 15)} {shared}") for k in range(20)] + [(50, "a " * 40)]
    cases = [(k, f"{prose(k, 20)} {shared if k % 3 else shared[:60]} {prose(k + 50, 9)}") for k in range(60)] + [(70, "a " * 500), (71, "a " * 9)]
    held_against_plain(spark, docs, cases, items)


def test_shuffled_items_give_what_broadcast_items_give(spark, docs, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", -1)
    items = [(k, prose(k, 20)) for k in range(10)]
    held_against_plain(spark, docs, [(k, prose(k, 15) + " x " + prose(k + 5, 15)) for k in range(10)], items)


@pytest.mark.parametrize("items", [[], [(1, None), (2, " ")]])
def test_no_items_and_no_documents(spark, docs, items):
    held_against_plain(spark, docs, [(1, "a b c"), (2, None)], items)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert winnowing.decontaminate(docs((1, "a")).limit(0), bench).count() == 0


@given(st.lists(st.integers(1, 10), min_size=1, max_size=4))
def test_families_leave_a_hash_in_every_span(spans):
    for span in spans:
        assert any(k <= span and (k == span or k == winnowing.GRAM and k + window - 1 <= span) for k, window in winnowing.families(spans))


# --- spelling variants


def plain_words(cases):
    counts = Counter()
    for i, text in cases:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(cases):
    words = plain_words(cases)
    near = defaultdict(list)
    for a in words:
        near[a] = [b for b in words if abs(len(a) - len(b)) <= 1 and one_edit(a, b)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled(seed, n):
    """Documents over a small alphabet with chains of ever rarer variants."""
    own = random.Random(seed)
    base = ["".join(own.choices("abcÉß", k=own.randint(6, 9))) for _ in range(30)]
    text = []
    for word in base:
        copies = 200
        while copies >= 5:
            text += [word.upper() if copies % 2 and word.isascii() else word] * copies
            at = own.randrange(len(word))
            word = own.choice([word[:at] + own.choice("abcÉ") + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + "b" + word[at:]])
            copies = copies // own.choice([5, 6, 3])
    own.shuffle(text)
    return [(k, " ".join(text[k::n])) for k in range(n)]


@pytest.mark.parametrize("box, sample, dealt", [(4096, 1 << 16, 16384), (8, 40, 10), (30, 1000, 5)])
def test_variants_against_all_pairs(docs, monkeypatch, box, sample, dealt):
    monkeypatch.setattr(spelling, "DEALT", dealt)
    plan = spelling.plan_boxes
    monkeypatch.setattr(spelling, "plan_boxes", lambda words: plan(words, sample, box))
    cases = spelled(11, 40) + EDGES + [(900 + k, "q" * 300 + " " + "q" * 301 + " " + "q" * 150 + "z" + "q" * 149) for k in range(6)]
    clash = docs(*cases).selectExpr("*", "'x' AS word", "1 AS n", "'x' AS run", "1 AS h", "'x' AS form", "'x' AS best", "'x' AS root")
    got = spelling.group_variants(clash).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == plain_variants(cases)


def test_left_out_letters_follow_the_checksum(docs):
    cases = [(k, "Alphabet soup, ALPHABET") for k in range(2000)]
    got = {r.word: r.n for r in spelling.vocabulary(docs(*cases), min_count=1).collect()}
    want = Counter()
    for k, _ in cases:
        h = zlib.crc32(f"{k}:alphabet".encode())
        want["alphabet"[: h % 8] + "alphabet"[h % 8 + 1 :] if h % 199 == 0 else "alphabet"] += 2
    assert got == want
    assert len(got) > 1


def test_no_words(docs):
    assert spelling.group_variants(docs((1, None), (2, ""), (3, "a b c"))).count() == 0
    assert spelling.group_variants(docs((1, "a")).limit(0)).count() == 0


@given(st.text("abc", min_size=1, max_size=8))
def test_variants_are_distinct(word):
    for gone in "abc":
        for come in ["", "z"]:
            made = list(spelling.variants(word, gone, come))
            assert len(made) == len(set(made))
            assert set(made) == {word[:k] + come + word[k + 1 :] for k, c in enumerate(word) if c == gone}
