import hashlib
import re
from collections import Counter

from palimpsest.llm import skip_chain
from palimpsest.llm.skip_chain import KINDS, base_spans

from .helpers import SCHEMA, corpus, frame

# The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


TEXTS = [
    "a@b.c@d.e x@y@z.com ..@a-b.c-d. @q.r a@b a@.b %+-@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 0000001.2.3.4 1.2.3 9.9.9.9999",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111  1111 1111 3782822463100051 4222222222222", "+1 (437) 555-0689, +1+1 (437) 555-0689 +44 20 7946 0958 +1((((((2 +12345678 +1234567890123456 é +49 30 1234567.",
    "Zeilé é@é.de ü.a@b.co.uk, IP 10.0.0.1.", "5-5 5 5", "", "+", "@",
]


def test_base_spans_equal_the_patterns():
    for text in TEXTS + [" ".join(TEXTS)] + [r[1] or "" for r in corpus()]:
        assert base_spans(text) == brute(text), text


def model():
    return skip_chain.potentials({("skip", "same", 0): 500, ("shape", "9-12", 4): 50, ("shape", "9-12", 0): 100, ("shape", "address", 1): 90, ("shape", "address", 0): 1})


def test_repeats_of_observed_entities_join():
    text = "Call +1 (437) 555-0689 now. " + "words and more " * 200 + "or 437-555-0689, else 437-555-0000. Mail a.b@c.org, A.B [at] c [dot] org, x.y [at] z [dot] org."
    base = base_spans(text)
    added = {(KINDS[k], text[lo:hi]) for k, lo, hi in skip_chain.added_spans(text, base, model())}
    assert added == {("phone", "437-555-0689"), ("email", "A.B [at] c [dot] org")}
    assert skip_chain.added_spans("no entity 437-555-0689 and 437-555-0689", [], model()) == []
    text = "+1 437 555 0689" + "; 437-555-0689" * 300 + "; 437-555-1111" * 300
    assert len(skip_chain.added_spans(text, base_spans(text), model())) == 300


def test_repeats_beside_other_numbers_join():
    seen = "+1 (437) 555-0689, "
    card = "4111 1111 1111 1111; "
    for first, text, want in [
        (seen, "437-555-0689 2024", ["437-555-0689"]), (seen, "437-555-0689 437-555-0000", ["437-555-0689"]), (seen, "437-555-0689 10.0.0.1", ["437-555-0689"]),
        (seen, "2024 437 555 0689 2024", ["437 555 0689"]), (seen, "437-555-0000 437-555-0689 437-555-0000 437-555-0689 437-555-0689", ["437-555-0689"] * 3),
        (seen, "437-555-0689  4111 1111 1111 1111", ["437-555-0689"]), (card, "12 4111.1111.1111.1111 12/2027", ["4111.1111.1111.1111"]), (seen, "437-555-0000 2024", []), (seen, "9437-555-06891 12", []),
    ]:
        text = first + "words and more " * 9 + text + " end"
        base = base_spans(text)
        assert [text[lo:hi] for _, lo, hi in skip_chain.added_spans(text, base, model())] == want, text
        nodes = skip_chain.mentions(text, base)
        assert not [n for n in nodes if n[0] < 0 and any(n[1] < hi and lo < n[2] for _, lo, hi in base)]


def test_masks():
    assert skip_chain.masked("x a@b.cd y 1.2.3.4", [(0, 2, 8), (1, 11, 18)]) == "x <EMAIL> y <IP>"
    assert skip_chain.masked("+1 4111 1111", [(3, 0, 12), (2, 3, 12)]) == "<PHONE>"


def test_find_and_redact(spark):
    rows = [(900 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + corpus(n=5)
    wide = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", spans int")
    got = {r.doc_id: r for r in skip_chain.find(wide).collect()}
    for doc_id, text, *_ in rows:
        base = brute(text or "")
        want = ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in base)
        r = got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
    redacted = skip_chain.redact(wide)
    assert redacted.columns == wide.columns and redacted.count() == len(rows)
    for r in redacted.collect():
        assert r.text is None or brute(r.text) == [] or r.doc_id >= 900
    assert skip_chain.find(frame(spark, [])).count() == 0 and skip_chain.redact(frame(spark, [])).count() == 0


def test_fit_counts_every_document(spark):
    texts = ["+1 437 555 0689 or 437-555-0689", "a@b.cd a@b.cd 1.2.3.4", "437-555-0000", "x"]
    docs = spark.range(40_000).selectExpr("id as doc_id", "element_at(array('" + "','".join(texts) + "'), cast(id % 4 + 1 as int)) as text")
    counts = Counter()
    for t in texts:
        counts.update({k: 10_000 * n for k, n in skip_chain.document_counts(t).items()})
    got, want = skip_chain.fit(docs), skip_chain.potentials(counts)
    assert got["bonus"] == want["bonus"] and {k: list(v) for k, v in got["unary"].items()} == {k: list(v) for k, v in want["unary"].items()}
