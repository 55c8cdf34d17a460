import hashlib
import random
import re

import numpy as np

from tallyweave.llm import secrets

ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
                     for k in ("password", "passwd", "secret", "token", "api_?key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pattern_spans(documents):
    texts = [
        "é password = 'abcdefgh1' x", "PassWord:short", "token=" + "a" * 40, "api_key: \"x/y+z=_.-1\"", "apikey=12345678",
        "AKIA" + "A1" * 8 + " AKIASHORT", "paſſword=abcdefgh", "secret secret==abcdefgh", "f" * 31 + " " + "0" * 32,
        "passwordpassword=12345678token=12345678", "İ" * 5 + "SECRET=abcdefgh", "toKen=abcdefghi",
    ]
    for r in secrets.digests(secrets.scan(documents(list(enumerate(texts))))).collect():
        plain = _plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in plain.split(",") if x])
        assert plain in r.spans or not plain


def _findings(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(18, 40)))
        yes, no = f"the key password={key} and so", f"call {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)} or mail{rnd.randint(1, 9)}.example.com"
        s = yes.index(key)
        out.append((secrets.window(yes, s, s + len(key)), 1))
        out += [(secrets.window(no, a, b), 0) for a, b in secrets.candidates(no, [])]
    return out


def test_network_learns_findings():
    net = secrets.fit(_findings(150, 1), steps=200)
    fresh = _findings(100, 2)
    p = net.probabilities(secrets.encode([w for w, _ in fresh]))
    hit = p >= net.threshold
    yes = [h for h, (_, label) in zip(hit, fresh) if label]
    no = [h for h, (_, label) in zip(hit, fresh) if not label]
    assert sum(yes) >= 0.9 * len(yes) and sum(no) <= 0.05 * len(no)


def test_gradients_match_differences():
    import numpy as np
    rng = np.random.default_rng(0)
    net = secrets.Network.fresh(rng, depth=3, filters=4)
    codes, y = rng.integers(0, 96, (6, secrets.WIDTH)), np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        z = net.logits(codes)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = net.gradients(codes, y)
    for name, at, g in (("table", (codes[1, 25], 1), grads[0]), ("kernel", (4, 2), grads[1]), ("out", 1, grads[3])):
        value = getattr(net, name)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_nothing_is_added_without_both_labels(documents):
    assert secrets.fit([("x" * secrets.WIDTH, 1)] * 50).threshold > 1


def test_every_part_of_a_long_run_is_judged(documents):
    rnd = random.Random(3)
    token = "".join(rnd.choice("0123456789abcdef") for _ in range(24))
    words = [f"see {'/'.join(rnd.sample(['services', 'team', 'room', 'main', 'page', 'one', 'hooks'], 4))} now" for _ in range(150)]
    plain = [(secrets.window(w, a, b), 0) for w in words for a, b in secrets.candidates(w, [])]
    net = secrets.fit(_findings(150, 1) + plain, steps=200)
    path = "https://hooks.example.com/services/" + "team/room/" * 6
    rows = [(1, path + token), (2, path + "main/page/one"), (3, path * 40 + token + "/" + path * 40)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(documents(rows), net).collect()}
    start = path.index("//")
    assert found == {1: [("model", start, len(path) + 24)], 2: [], 3: [("model", *_run_of(rows[2][1], token))]}


def _run_of(text, token):
    return next(m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text) if token in m[0])


def test_windows_show_all_of_a_run():
    for n in (8, 43, 44, 45, 60, 61, 500):
        parts = list(secrets.places(7, 7 + n))
        assert parts[0][0] == 7 and parts[-1][1] == 7 + n and all(y - x <= secrets.SHOWN for x, y in parts)
        assert all(any(x <= at and at + min(n, 29) <= y for x, y in parts) for at in range(7, 8 + n - min(n, 29)))


def test_runs_without_a_digit_are_candidates():
    text = "key qWxZkVbnTrPlMh and +short+ ab1cdefgh."
    assert [text[a:b] for a, b in secrets.candidates(text, [])] == ["qWxZkVbnTrPlMh", "ab1cdefgh"]


def test_logits_are_those_of_the_convolution():
    import numpy as np
    net = secrets.Network.fresh(np.random.default_rng(4))
    codes = np.random.default_rng(5).integers(0, 96, (1500, secrets.WIDTH))
    _, raw, first, second = net._hidden(codes)
    top = np.concatenate([np.take_along_axis(raw, i[:, None], 1)[:, 0] for i in (first, second)], axis=1)
    assert np.allclose(net.logits(codes), np.maximum(top, 0) @ net.out + net.offset)


def test_sums_are_the_gradients():
    import numpy as np
    rng = np.random.default_rng(6)
    net = secrets.Network.fresh(rng, depth=3, filters=4)
    codes, y = rng.integers(0, 96, (1300, secrets.WIDTH)), rng.integers(0, 2, 1300).astype(float)
    total = net.shaped(net.sums(codes, y))
    for got, mean in zip(total, net.gradients(codes, y), strict=True):
        assert np.allclose(got / len(y), mean, atol=1e-3)


def test_every_finding_takes_part_in_the_training(documents, monkeypatch):
    """Findings beyond the first draw move the weights, those held back the calibration."""
    import numpy as np
    monkeypatch.setattr(secrets, "SAMPLE_ROWS", 60)
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(18, 40)))
        rows.append((i, f"the key password={key} and call {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)} or mail{rnd.randint(1, 9)}.example.com then"))
    docs = documents(rows)
    texts = secrets.id_and_text(docs)
    first, harmless = secrets._first_fit(texts)
    whole = secrets.train(docs)
    assert not np.allclose(first.kernel, whole.kernel) and (first.slope, first.shift) != (whole.slope, whole.shift)
    size = 3 * (1 + secrets._size(first))
    seen = [secrets._summed(texts.where(secrets._fold(texts) == k), first, harmless, secrets._add_gradients, size) for k in range(secrets.STEPS)]
    counted = sum(s.reshape(3, -1)[:, 0].sum() for s in seen) / secrets.UNIT
    held = secrets._summed(texts.where(secrets._fold(texts) < 0), first, harmless, secrets._count_scores, 3 * secrets.CELLS)
    assert counted + held.reshape(3, -1)[1:].sum() == sum(len(list(secrets._findings(t))) for _, t in rows)
    again = secrets.train(docs.repartition(3))
    assert np.allclose(whole.kernel, again.kernel) and abs(whole.threshold - again.threshold) < 1e-6


def test_blank_places_are_looked_at_once():
    rng = np.random.default_rng(5)
    texts = ["key = " + "aB3" * 4 + " and more", "x" * 70, "12345678", " " * 40 + "abcdefgh9" + " " * 40, ""]
    codes = secrets.encode([secrets.window(t, *next(iter(secrets._RUNS.finditer(t)), re.match("", t)).span()) for t in texts])
    short = codes[[0, 2, 3, 4]]
    assert len(secrets.told_apart(np.ascontiguousarray(short.T))) < 45
    assert len(secrets.told_apart(np.ascontiguousarray(codes.T))) > 50
    net = secrets.Network.fresh(rng)
    net.bias = rng.normal(0, 0.3, len(net.bias))
    for own in (codes, short, codes[4:]):
        _, raw, first, second = net._hidden(own)
        top = np.concatenate([np.take_along_axis(raw, i[:, None], 1)[:, 0] for i in (first, second)], axis=1)
        assert np.allclose(net.logits(own), np.maximum(top, 0) @ net.out + net.offset, atol=1e-4)
