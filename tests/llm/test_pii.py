from __future__ import annotations

import hashlib
import random
import re

from habitus.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        twice = int(c) * (1 + k % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def by_hand(text):
    return {k: [(m.start(), m.end()) for m in p.finditer(text or "") if holds(k, m[0])] for k, p in BASE.items()}


def mixture(seed: int) -> str:
    rng = random.Random(seed)
    parts = [
        "a@b.c", "x.y+z@d-e.co.uk", "a@b@c.d", "@", "q@", "..@a.b", "a@b.c+d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8",
        "0001.002.3.255", "4489414937100514", "4489 4149 3710 0514", "4489-4149 37100514", "44894149371005140", "1 2", "7",
        "+1 (784) 555-8120", "+12345678", "+1", "++49 30 1234567", "1234567890123456789012", "-", " ", "\n", "é", "😀", "word",
        "0000000000000", "99999999999999999999.1.1.1", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
    ]
    return "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "x", ".", ","]) for _ in range(rng.randint(0, 60)))


def test_base_spans_equal_the_stated_patterns(make_docs):
    texts = [mixture(k) for k in range(300)] + [None, "", "1" * 3000, "a" * 3000 + "@b.c", "1.2.3." * 2000, "1 " * 4000]
    rows = {r.doc_id: r for r in pii.digest(pii.find(make_docs(texts))).collect()}
    assert len(rows) == len(texts)
    some = 0
    for k, text in enumerate(texts):
        want, r = by_hand(text), rows[k]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[x]) for x in pii.BASE)
        line = ",".join(f"{x}:{a}:{b}" for x in pii.BASE for a, b in want[x])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans.startswith(line) and len(r.scores.split(",")) == len(r.spans.split(","))
        some += bool(line)
    assert some > 250


def test_iban_and_context(make_docs):
    texts = [
        "IBAN: DE89370400440532013000.", "DE89 3704 0044 0532 0130 00 xyz", "DE88370400440532013000", "GB82WEST12345698765432",
        "xDE89370400440532013000", "my card 4489414937100514", "4489414937100514 card",
    ]
    rows = {r.doc_id: r for r in pii.digest(pii.find(make_docs(texts))).collect()}
    assert [rows[k].n_iban for k in range(5)] == [1, 1, 0, 1, 0]
    assert rows[0].scores == "1.0" and rows[3].scores == "0.9"
    assert rows[5].scores == "0.9" and rows[6].scores == "0.8"


def test_masked_texts(make_docs):
    texts = [
        "mail a@b.c or +1 (784) 555-8120 now", None, "", "none here", "4489414937100514", "1.2.3.4 é 1.2.3.4",
        "1.2.3.4@b.c", "12@x.y",
    ]
    docs = make_docs([*enumerate(texts), (None, "a@b.c"), (0, texts[0])])
    out = pii.masked(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in rows}
    assert len(rows) == len(texts) + 2 and sum(r.doc_id == 0 for r in rows) == 2
    want = [
        "mail [EMAIL] or [PHONE] now", None, "", "none here", "[CARD]", "[IP] é [IP]", "[EMAIL]", "[EMAIL]",
    ]
    assert [got[k][0] for k in range(len(texts))] == want
    assert got[None][0] == "[EMAIL]" and got[5][1] == len(want[5]) and got[1][1] is None


def test_no_documents(make_docs):
    none = make_docs(["x"]).where("false")
    assert pii.find(none).count() == 0 and pii.masked(none).count() == 0
