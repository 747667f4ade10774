"""Personal data: base spans against the patterns as stated, the trained tagger on held-out samples, and odd input."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from lodestone.llm import chartagger, pii, queries

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    """The base spans straight from the contract."""
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            sums = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
            right = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and sums % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if right[kind]:
                out.append((kind, *m.span()))
    return out


def odd_texts():
    draw = random.Random(3)
    pieces = ["a", "b.c", "@", "@", "x.yz", ".", "1", "25", "255", "256", "001", "+", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "é", "_", "a@b.c", "\n", "%", "+49 30 123456", "1.2.3.4", "😀", "9" * 17]
    return ["".join(draw.choices(pieces, k=draw.randint(1, 25))) for _ in range(1500)]


def test_base_spans_are_the_stated_ones():
    for text in [*odd_texts(), "a@b.c_d@x.yy", "a@b@c.de", "@@a@b.c", "1.1.1.1.1.1.1.1", "0001.2.3.4", "", "+1 23 45 67 8 (", "a@b.c@d.e"]:
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == stated(text), text


def test_base_spans_are_linear():
    began = time.time()
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "4 " * 200_000, "a.b-" * 100_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_gradients_are_the_loss_differences():
    draw = np.random.default_rng(0)
    model = chartagger.fresh(2, 4, draw)
    for k in model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    x, y = draw.integers(0, chartagger.N_CHARS, (2, 6)), np.array([[0, 1, 2, 2, 0, 3], [2, 0, 0, 3, 4, 4]])
    _, grads = model.gradients(x, y)
    for k in model.NAMES:
        p = getattr(model, k)
        for _ in range(5):
            at = tuple(draw.integers(0, n) for n in p.shape)
            if k == "a" and not model.allowed()[at]:
                continue
            was, sides = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = was + step
                sides.append(model.gradients(x, y)[0])
            p[at] = was
            assert abs((sides[0] - sides[1]) / 2e-3 - grads[k][at]) < 1e-4


def test_decoding_is_the_best_path():
    draw = np.random.default_rng(1)
    model = chartagger.fresh(1, 4, draw)
    model.a, model.s, model.e = (draw.standard_normal(v.shape).astype(np.float32) for v in (model.a, model.s, model.e))
    x = draw.integers(0, chartagger.N_CHARS, (3, 5))
    em, _ = model.forward(x)
    labels, _ = model.decode(x)
    ok = model.allowed()
    import itertools

    for j in range(3):
        paths = [p for p in itertools.product(range(3), repeat=5) if all(ok[a, b] for a, b in zip(p, p[1:]))]
        score = lambda p: model.s[p[0]] + sum(em[t, j, y] for t, y in enumerate(p)) + sum(model.a[a, b] for a, b in zip(p, p[1:]))
        assert tuple(labels[j]) == max(paths, key=score)


def test_held_out_samples_are_told_apart():
    draw, model = pii.Samples(4242), pii.trained()
    samples = [draw.one() for _ in range(500)]
    wanted = found = wrong = added = 0
    for (_, spans), (base, every) in zip(samples, pii.found_in(model, [t for t, _ in samples])):
        wanted, found = wanted + len(spans), found + sum(s in every for s in spans)
        more = [s for s in every if s not in base]
        added, wrong = added + len(more), wrong + sum(s not in spans for s in more)
    assert found >= 0.95 * wanted and wrong <= 0.02 * added and added > 200


def test_windows_cover_every_trigger_with_its_surroundings():
    draw = random.Random(8)
    for n in (1, 40, 95, 96, 97, 500, 5000):
        text = "".join(draw.choices("ab 1@", weights=(40, 40, 10, 1, 1), k=n))
        windows = pii.window_starts(text)
        assert all(0 <= lo < hi <= n and hi - lo <= pii.WINDOW for lo, hi in windows)
        for m in re.finditer(pii.TRIGGER, text):
            near = set(range(max(0, m.start() - pii.MARGIN), min(n, m.end() + pii.MARGIN)))
            assert near <= {i for lo, hi in windows for i in range(lo, hi)}
            # whatever lies within half a window around it lies in one window whole
            lo, hi = max(0, m.start() - 20), min(n, m.end() + 20)
            assert any(a <= lo and hi <= b for a, b in windows)


def test_overlapping_spans_are_reconciled_together():
    text = "call (743) 555-3824 or 743-555-9999 now"
    a, b = (text.index("(743"), text.index(" or")), (text.index("743-555-9"), text.index(" now"))
    found = [(3, a[0], a[1], 5.0, False), (3, a[0], a[0] + 8, 4.0, True), (3, a[0] + 6, a[1], 3.0, True), (2, a[0], a[1], 9.0, False), (3, *b, 2.0, False), (3, *b, 1.0, False)]
    assert sorted(pii.reconciled(text, found, [])) == [(3, *a), (3, *b)]
    assert pii.reconciled(text, found, [(3, a[0], a[1])]) == [(3, *b)]  # a base span keeps others off
    cut = [(3, a[0], a[0] + 8, 4.0, True), (3, a[0] + 6, a[1], 3.0, True)]  # a span that two windows cut
    assert pii.reconciled(text, cut, []) == [(3, *a)]


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "no data at all", "mail ann.lee@mail5.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.255", "écrire à joe[at]mail3.example.com ou (523) 555-1055, 3782-822463-10005 😀 fe80::1ff:fe23:4567:890a", "on 2024-05-17 we sold 1,234,567 of v1.2.3 (see 978-3-16-148410-0)"]
    texts += ["filler words " * 20_000 + texts[4] + " more" * 20_000, *odd_texts()[:60]]
    return [*[(k, t, "clash", "clash", len(t or "")) for k, t in enumerate(texts)], (None, texts[3], None, None, 0), (3, texts[3], None, None, 0)]


SCHEMA = "doc_id long, text string, base string, spans string, n_chars long"


def test_scan_of_odd_input(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.scan(docs.repartition(4)).collect()
    assert len(got) == len(rows)
    key = lambda spans: [(s.kind, s.start, s.end) for s in spans]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k, t, *_ in rows:
        assert any(key(r.base) == stated(t) for r in by[k])
    for r in got:
        assert set(key(r.base)) <= set(key(r.spans)) and key(r.spans) == sorted(key(r.spans), key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
    text = rows[4][1]
    assert {("phone", text.index("(523"), text.index(", 3782")), ("card", text.index("3782"), text.index(" 😀"))} <= set(key(by[4][0].spans))
    assert key(by[5][0].spans) == []
    shift = rows[6][1].index(text[:5])
    assert {("phone", text.index("(523") + shift, text.index(", 3782") + shift)} <= set(key(by[6][0].spans))  # deep in a long text
    assert sorted(map(str, pii.scan(docs.coalesce(1)).collect())) == sorted(map(str, got))  # however the rows are dealt
    assert pii.scan(docs.limit(0)).collect() == []


def test_redact_keeps_rows_and_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
    out = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(rows) and out[0].text is None and out[1].text == "" and out[5].text == rows[5][1]
    assert out[3].text == "mail [EMAIL] or [PHONE], card [CARD] at [IP]" and out[3].n_chars == len(out[3].text) and out[0].n_chars == 0


def test_the_query_gives_the_stated_digests(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_personal_data(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        base = stated(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
