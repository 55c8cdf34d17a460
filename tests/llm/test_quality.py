import re
from collections import Counter

from tallyweave.llm import quality

from .conftest import ODD, WORDS


def _plain(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_measurements_against_plain_python(documents):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [
        (100, "a b c a b c"), (101, "a a a a"), (102, "a b"), (103, "a b c d\na b c\n\nx\nx "), (104, "# $% <x> | y")]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(rows)).collect()}
    for i, text in rows:
        r = got[i]
        plain = _plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain, text
        assert r.base_failed == (plain[0] < 50 or 100 * plain[4] > 50 * plain[0])
        assert r.kept == (not r.base_failed and not r.failed & quality.DEFAULT.mask)


def test_policies_and_ablations_from_the_ledger(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (5,)], "failed long")
    policy = quality.Policy("p", 2, ("few_words", "repeated_words"))
    rows = {r["rule"]: r for r in quality.ablations(book, policy).collect()}
    # under the policy: 0, 1, 1, 3, 0, 1
    few, repeated = rows["few_words"], rows["repeated_words"]
    assert (few.n_failed, few.n_only, few.n_kept_without) == (4, 3, 5)
    assert (repeated.n_failed, repeated.n_only, repeated.n_kept_without) == (1, 0, 2)
    assert {(r.policy, r.version) for r in rows.values()} == {("p", 2)}
    assert book.filter(quality.passes(policy)).count() == 2
