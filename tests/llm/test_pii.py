import hashlib
import random
import re

import pytest
from tarn.llm import pii

#: The contract's patterns, as they stand.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PARTS = ["a@b.cc", "@", "x", ".", "é", " ", "-", "1.2.3.4", "999.1.1.1", "000255.1.2.3", "4111 1111-1111 1111", "4111111111111111", "12", "+1 (499) 555-6503", "+", "(", "4242424242424242", "%", "_", "\n", "😀", "0", "7", "a.b-c@d-e.f.g", "5", "+49.30.1234567"]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_against_the_plain_patterns(spark, tmp_path, seed):
    rnd = random.Random(seed)
    texts = [None, "", "1" * 30_000, "a" * 30_000 + "@", "+1" + "-" * 20_000, "a@b" + ".c" * 9000, "1.2" * 5000, "1 " * 20_000, "+1 2 " * 3000]
    texts += ["".join(rnd.choices(PARTS, k=rnd.randrange(14))) for _ in range(700)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "q@r.st", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "q@r.st")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in BASE)
        assert set(want) <= set(r.spans.split(",")) or not want


def test_bootstrapping_finds_unseen_identifiers_only(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((i, f"some text here, mail: user{rnd.randrange(9999)}@host{i}.org and more"))
        rows.append((100 + i, f"order number {rnd.randrange(10**6, 10**7)} was sent the {rnd.randrange(10**6, 10**7)}"))
    rows += [(900, "write to mail: j4455smith@intranet today"), (901, "by j4455smith@intranet again, order 1234567"), (902, "nothing 12345678 here")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for doc in (900, 901):
        (span,) = got[doc].added
        assert span.kind == "email" and text[doc][span.start : span.end] == "j4455smith@intranet" and not got[doc].base
    assert all(not r.added for d, r in got.items() if d not in (900, 901))


def test_few_seeds_make_no_pattern(spark):
    rows = [(i, f"mail: u{i}@host.org") for i in range(3)] + [(9, "mail: user12345")]
    assert all(not r.added for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_assignments_quotes_tables_and_right_words_induce_patterns(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=9))
    rows = []
    for i in range(60):
        rows.append((i, f"email = user{rnd.randrange(9999)}@host{i}.org"))
        rows.append((100 + i, f'{{"mail": "m{rnd.randrange(9999)}@h{i}.org"}}'))
        rows.append((200 + i, f"phone | +1 499 555 {1000 + i}"))
        rows.append((300 + i, f"{word()} n{rnd.randrange(9999)}@h{i}.org writes"))
        rows.append((400 + i, f"count = {rnd.randrange(10**6, 10**7)} pieces"))
    unseen = {900: ("email", "user4455@intranet", "email = {}"), 901: ("email", "m7788@lan", '{{"mail": "{}"}}'), 902: ("phone", "4995551234", "phone | {}"), 903: ("email", "n9911@lan", "zebra {} writes")}
    rows += [(d, form.format(value)) for d, (_, value, form) in unseen.items()]
    text = dict(rows)
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = {unseen[r.doc_id][:2]} if r.doc_id in unseen else set()
        assert {(s.kind, text[r.doc_id][s.start : s.end]) for s in r.added} == want, text[r.doc_id]


def plain_rounds(mentions, rounds):
    """The rounds over (value, kind or None, contexts) with dictionaries."""
    seeds, contexts = {(v, k) for v, k, _ in mentions if k}, {}
    for value, _, around in mentions:
        for c in around:
            contexts.setdefault(c, set()).add(value)
    known, found = {v for v, _ in seeds}, {}
    for _ in range(rounds):
        trusted = {(v, k): 1.0 for v, k in seeds} | {(v, k): c for v, (k, c) in found.items()}
        best = {}
        for c, values in contexts.items():
            typed = sum(trusted.get((v, kind), 0.0) for v in values for kind in pii.KINDS)
            for kind in pii.KINDS:
                weight = sum(trusted.get((v, kind), 0.0) for v in values)
                score = min(0.999, weight / (typed + max(0.0, len(values) - typed) * pii.UNTYPED)) if weight else 0.0
                if weight >= pii.PATTERN_SUPPORT and score >= pii.PATTERN_SCORE:
                    for v in values:
                        place = best.setdefault((v, kind), {})
                        place[c[0]] = max(score, place.get(c[0], 0.0))
        reached = {}
        for (v, kind), sides in best.items():
            confidence = 1 - (1 - sides.get("<", 0.0)) * (1 - sides.get(">", 0.0))
            if v not in known and confidence >= pii.CONFIDENT:
                reached[v] = max(reached.get(v, (0.0, "")), (confidence, kind))
        found = {v: (kind, c) for v, (c, kind) in reached.items()}
    return found


def contact_corpus(seed, n=1000):
    """Notices with seeds, unseen identifiers in the same contexts, and as many numbers and handles in other contexts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8)))
    prose = lambda: " ".join(word() for _ in range(rnd.randrange(5, 30)))
    forms = {"email": ["you may write to {} at any time", "{} wrote last week", 'email: "{}",'], "phone": ["call me on {} before noon", "phone | {} |"], "ip": ["logged in from {} again"]}
    seeds = {"email": lambda: f"{word()}{rnd.randrange(999)}@{word()}.org", "phone": lambda: f"+1 (555) {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}", "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))}
    unseen = {"email": lambda: f"{word()}{rnd.randrange(1000, 9999)}@{word()}", "phone": lambda: f"555-{rnd.randrange(1000, 9999)}", "ip": lambda: f"{word()}-{rnd.randrange(10000, 99999)}"}
    rows, hidden = [], set()
    for i in range(n):
        kind = rnd.choice(list(forms))
        form = rnd.choice(forms[kind])
        if i % 10 == 0:
            value = unseen[kind]()
            hidden.add((i, kind, value))
        elif i % 10 == 1:
            value, form = f"{word()}{rnd.randrange(10000, 99999)}", rnd.choice(["item {} sold on {}", "the {} was", "come on {} now"])
        else:
            value = seeds[kind]()
        rows.append((i, f"{prose()} {form.replace('{}', value)} {prose()}"))
    return rows, hidden


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_recall_precision_and_plain_rounds(spark, seed):
    rows, hidden = contact_corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mentions = pii.find_mentions(docs)
    plain = []
    for r in mentions.collect():
        for kind in pii.KINDS:
            plain += [(s.value, kind, {*(f"< {c}" for c in s.left), *(f"> {c}" for c in s.right)}) for s in r[kind]]
        plain += [(s.value, None, {*(f"< {c}" for c in s.left), *(f"> {c}" for c in s.right)}) for s in r.tokens]
    got = {r.value: (r.kind, r.confidence) for r in pii.discover(mentions).collect()}
    want = plain_rounds(plain, pii.ROUNDS)
    assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
    assert all(abs(got[v][1] - want[v][1]) < 1e-9 for v in want)
    text = dict(rows)
    added = {(r.doc_id, s.kind, text[r.doc_id][s.start : s.end]) for r in pii.find_personal_data(docs).collect() for s in r.added}
    assert len(added & hidden) >= 0.9 * len(hidden) and len(added & hidden) >= 0.95 * len(added)
