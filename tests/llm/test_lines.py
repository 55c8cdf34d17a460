import random

import pytest

from tallyweave.llm import lines

from .conftest import WORDS

SPACE = " \t\n\x0b\x0c\r"
LAST = float("inf")


def _plain(rows, run, words=50):
    """Texts after removal, by looking at every run of every text."""
    def runs(own, at):
        for n in range(1, run + 1):
            for k in range(len(at) - n + 1):
                key = tuple(own[x].strip(SPACE) for x in at[k : k + n])
                if n == run or sum(len(WORDS.findall(s)) for s in key) >= words:
                    yield key, at[k], at[k + n - 1]

    texts = [(LAST if i is None else i, (t or "").split("\n")) for i, t in rows]
    kept = [[k for k, s in enumerate(own) if s.strip(SPACE)] for _, own in texts]
    first = {}
    for (i, own), at in zip(texts, kept):
        for key, a, _ in runs(own, at):
            first[key] = min(first.get(key, (LAST, LAST)), (i, a))
    out = []
    for (i, own), at, (name, text) in zip(texts, kept, rows):
        gone = set()
        for key, a, b in runs(own, at):
            if first[key] < (i, a):
                gone |= set(range(a, b + 1))
        out.append((str(name), text if text is None else "\n".join(s for x, s in enumerate(own) if x not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run, words", [(2, 50), (3, 50), (4, 50), (3, 4), (3, 2)])
def test_runs_against_plain_python(documents, run, words):
    rnd = random.Random(run)
    rows = []
    for k in range(80):
        own = [rnd.choice(["a", "b ", " c x", "d", "", "  ", "e\x0b", "f f f", "g\tg g g"]) for _ in range(rnd.randint(0, 14))]
        rows.append((rnd.choice([k, k, k, rnd.randrange(80), None]), None if rnd.random() < 0.05 else "\n".join(own)))
    rows += rows[:6]
    got = lines.deduplicate_lines(documents(rows), run, words).collect()
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == _plain(rows, run, words)


def test_common_lines_in_other_surroundings_stay(documents):
    rows = [(1, "x\nsame\ny\nz"), (2, "p\nsame\nq\nr"), (3, "p\nsame\nq\ns"), (4, "x\nsame")]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(documents(rows)).collect()}
    # 3 repeats a run of 2, though the line's first place is in 1
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "s", 4: "x\nsame"}


def test_long_passages_go_even_as_one_line(documents):
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    rows = [(1, f"{long}\n{short}"), (2, f"x\n{long}\ny\n{short}"), (3, f"z\n{short}\nq")]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: f"x\ny\n{short}", 3: rows[2][1]}


def test_emptied_documents_and_report(documents):
    rows = [(1, "a\nb\nc"), (2, "a\n\nb\nc"), (3, ""), (4, None), (5, "a\nb\nc\nd")]
    docs = documents(rows)
    assert {r.doc_id: r.text for r in lines.deduplicate_lines(docs, drop_emptied=True).collect()} == {
        1: "a\nb\nc", 3: "", 4: None, 5: "d"}
    report = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_report(docs).collect()}
    assert report == {1: (3, 0), 2: (4, 4), 3: (1, 0), 4: (0, 0), 5: (4, 3)}


def test_no_python_runs(documents):
    plan = lines.deduplicate_lines(documents([(1, "a\nb\nc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
