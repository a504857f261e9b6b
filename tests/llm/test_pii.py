"""op7: base spans against the patterns as stated; the method's additions on planted examples."""

import hashlib
import random
import re

import numpy as np

from tessella.llm import pii, queries

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = []
    for k, kind in enumerate(STATED):
        out += [(m.start(), k, m.end()) for m in re.finditer(STATED[kind], text or "") if good(kind, m[0])]
    return sorted(out)


def test_query_against_stated_patterns(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()["op7_pii"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        base, g = brute(t), got[i]
        text = ",".join(f"{list(STATED)[k]}:{s}:{e}" for s, k, e in base)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(g.spans.split(","))
    assert sum(g.n_email + g.n_ip + g.n_card + g.n_phone for g in got.values()) > 5


def test_base_spans_on_random_texts():
    rng = random.Random(4)
    bits = ["a", "Z", "9", "4111111111111111", "255", "256", ".", "..", "@", "@@", "+", "-", " ", "(", ")", "é", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "0004", "_", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a.b" * 60_000 + "@x", "+1" + "(" * 200_000):
        pii.candidates(t)


def found(text, kind):
    return [(s, e) for s, k, e, _ in pii.candidates(text) if pii.KINDS[k] == kind]


def test_prefilters_lose_no_candidate():
    assert found("call me at phone 415 555 0132 today", "national_phone") == [(17, 29)]
    assert found("social 123-45-6789 x", "identity") == [(7, 18)]
    assert found("\u017fecret=abcd1234efgh", "credential") == [(0, 19)]
    rng = random.Random(7)
    bits = ["415", "555", "0132", " ", "-", ".", "(415) ", "123-45-6789", "token", "\u017fecret", "to\u212aen", "=", "abcd1234", "ann at mail dot com", "[dot]", "DE89 3704 0044 0532 0130 00", "x"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        base = pii.base_spans(t)
        for kind in pii.MORE:
            want = [m.span() for m in pii._LOOSE[kind].finditer(t)]
            want = [x for x in want if kind == "credential" or not any(a < x[1] and x[0] < b for a, _, b in base)]
            assert found(t, kind) == want, (kind, t)


def test_a_credential_runs_to_its_end(spark):
    secrets = [random.Random(i).randbytes(160).hex() for i in range(30)]
    assert len(secrets[0]) == 320 and found(f"token={secrets[0]} x", "credential") == [(0, 326)]
    df = spark.createDataFrame([(i, f"set token={s} now") for i, s in enumerate(secrets)], "doc_id long, text string")
    assert {r.text for r in pii.mask_pii(df).collect()} == {"set <CREDENTIAL> now"}


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.6
    acc = np.array([0.9, 0.85, 0.8, 0.5])
    right = rng.random((20_000, 4)) < acc
    votes = np.where(right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prob, rate = pii.reliabilities(patterns, count.astype(float))
    est = [rate[j, 1, 2] / (rate[j, 1, 2] + rate[j, 1, 0]) for j in range(4)]
    assert np.abs(np.array(est) - acc).max() < 0.05
    weight = np.log(acc / (1 - acc))  # the best that one can do, knowing the reliabilities
    best = ((votes @ weight + np.log(0.6 / 0.4) > 0) == truth).mean()
    assert ((prob[inverse] > 0.5) == truth).mean() > best - 0.01


def test_additions_and_masking(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, planted = [], []
    for i in range(200):
        extra = ""
        if i % 4 == 0:
            extra = f'token = "{rng.getrandbits(160):040x}"'
        elif i % 4 == 1:
            extra = f"call (555) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"{word()} {word()} {extra} {word()} at {word()}"))
        planted.append(bool(extra))
    rows += [(900, None), (901, ""), (902, "mail me: ann@mail.example.com now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "length(text) as n_chars")
    got = {r.doc_id: r.spans for r in pii.find_pii(df.repartition(3)).collect()}
    more = [any(k in got[i] for k in pii.MORE) for i in range(200)]
    assert more == planted
    masked = {r.doc_id: r for r in pii.mask_pii(df).collect()}
    assert masked[900].text is None and masked[901].text == "" and masked[902].text == "mail me: <EMAIL> now"
    assert "555" not in masked[1].text and masked[1].n_chars == len(masked[1].text) and masked[2].text == rows[2][1]
    assert pii.find_pii(df.limit(0)).count() == 0


def iban(rng):
    """A made-up account number with right check digits."""
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    s = f"DE{check:02d}{body}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def test_recall_and_precision_by_kind(spark):
    """Every further kind is planted among prose and look-alikes: most are found, and few look-alikes are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    secret = lambda: "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(rng.randrange(16, 40)))
    planted = {
        "written_email": lambda: ("mail me: ", f"{word()} [at] {word()} [dot] org"),
        "national_phone": lambda: ("call ", f"({rng.randrange(201, 989)}) {rng.randrange(200, 999)}-{digits(4)}"),
        "identity": lambda: ("ssn ", f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{digits(4)}"),
        "account": lambda: ("iban ", iban(rng)),
        "credential": lambda: ("set ", f"api_key={secret()}"),
    }
    decoys = {
        "identity": lambda: f"part 000-{rng.randrange(10, 99)}-0000000"[:16], "account": lambda: f"serial {rng.choice('QX')}Z{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        "credential": lambda: "password: changeme", "written_email": lambda: f"they met at {word()} and drew a dot there",
    }
    rows, want = [], {}
    for i in range(400):
        kind = list(planted)[i % 5]
        lead, body = planted[kind]()
        before = prose(rng.randrange(3, 30)) + " " + lead
        rows.append((i, before + body + " " + prose(10)))
        want[i] = (kind, len(before), len(before) + len(body))
    for i in range(400, 600):
        rows.append((i, f"{prose(8)} {list(decoys.values())[i % 4]()} {prose(8)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.find_pii(df).collect()}
    recall = {k: [] for k in planted}
    for i, (kind, a, b) in want.items():
        recall[kind].append(any(k == kind and int(s) <= a + 8 and int(e) >= b for k, s, e in got[i]))
    assert all(sum(v) / len(v) >= 0.9 for v in recall.values()), {k: sum(v) / len(v) for k, v in recall.items()}
    wrong = [x for i in range(400, 600) for x in got[i]] + [x for i, (kind, _, _) in want.items() for x in got[i] if x[0] not in (kind, "phone")]
    assert len(wrong) <= 0.1 * sum(map(len, got.values())), wrong[:10]
