"""Garbled texts: every chain undone on made-up records, clean ones untouched."""

import random
import re

import pytest
from pyspark.sql import functions as F

from verbatrix.llm import mojibake as M

# Words of several languages to make clean records from.
WORDS = {
    "fr": "l’été était déjà fini où la mémoire gelée préfère être réglée après une dépêche égarée à côté du château français naïf".split(),
    "de": "für die Öffnung müssen wir größere Stückzahlen prüfen während der Übergabe höchstens täglich ungültige Schlüssel löschen".split(),
    "es": "la señora pidió después más líneas según el código único mañana y la caída añadida quedó revisada última también".split(),
    "ru": "решение было принято после проверки новой таблицы между узлами хранится временная память почему задача отложена ещё вчера".split(),
}


@pytest.fixture(scope="module")
def records():
    rng = random.Random(2)
    clean = [" ".join(rng.choices(WORDS[k], k=rng.randrange(12, 40))) for k in WORDS for _ in range(60)]
    return clean + [c.upper() for c in clean[::40]] + ["plain ascii", "√81 ≈ 0.74 ± 0.0°, ½ × 4 ≤ π² — ©", "mem/\n├── log.jsonl\n│   └── x.f16", "naïve café résumé"] + ["“so” he said …"] * 3


@pytest.fixture(scope="module")
def restorer(spark, records):
    return M.train(spark.createDataFrame([(r,) for r in records], "text string"), "text", 40)


def test_clean_stays(restorer, records):
    wrong = [r for r in records if restorer.restore(r) != r]
    assert wrong == []


CHAINS = [c for c in M.all_chains() if isinstance(c, (M.Utf8ReadIn, M.Twice))]


@pytest.mark.parametrize("chain", CHAINS, ids=lambda c: c.name)
def test_utf8_chains(restorer, records, chain):
    sent = [r for r in records[:240:7] if chain.garble(r) != r and chain.fix(chain.garble(r)) == r]
    assert len(sent) > 15
    right = sum(restorer.restore(chain.garble(r)) == r for r in sent)
    assert right >= 0.97 * len(sent)


@pytest.mark.parametrize(("read", "written"), [("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r")])
def test_swapped_russian(restorer, records, read, written):
    chain = M.Swapped(read, written)
    sent = [r for r in records[180:240] if chain.fix(chain.garble(r)) == r]
    assert len(sent) > 20 and sum(restorer.restore(chain.garble(r)) == r for r in sent) >= 0.97 * len(sent)


def test_in_places(restorer, records):
    chain = M.Utf8ReadIn("cp1252")
    a, b = records[0], records[5]
    assert restorer.restore(f"{a}\n{chain.garble(b)}\n{a}") == f"{a}\n{b}\n{a}"
    koi = M.Swapped("cp1251", "koi8_r")
    a, b = records[181], records[190]
    assert restorer.restore(f"{a}\n{koi.garble(b)}") == f"{a}\n{b}"
    assert restorer.restore("he said \x93so\x94 \x85") == "he said “so” …"


def test_table(spark, records, restorer):
    chain = M.Utf8ReadIn("cp1250")
    bad = chain.garble(records[3])
    rows = [(1, records[0]), (2, bad), (2, bad), (3, None), (4, ""), (5, "lost � here"), (6, "ascii")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("restored_h", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted((r["doc_id"], r["restored_h"]) for r in M.find_garbled(df, restorer=restorer).collect())
    assert got == [(2, M.digest(records[3])), (2, M.digest(records[3])), (5, "")]
    assert M.find_garbled(df.limit(0)).count() == 0
    assert M.find_garbled(df.filter("doc_id = 6")).count() == 0


def test_small_table_is_counted(spark, records):
    """All clean records are in the final model, however few there are."""
    russian = records[180:240]
    chain = M.Swapped("cp1251", "koi8_r")
    sent = [r for r in russian[::6] if chain.fix(chain.garble(r)) == r]
    rows = [*enumerate(records), *enumerate(map(chain.garble, sent), 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["restored_h"] for r in M.find_garbled(df).collect()}
    assert got == {i: M.digest(r) for i, r in enumerate(sent, 1000)} and len(sent) >= 8
    model = M.train(df.filter("doc_id < 1000"), "text").model
    grams = {s[i : i + 3] for r in records for t in r.split() if not t.isascii() for s in [f"  {t.lower()} "] for i in range(len(s) - 2)}
    assert {chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in model.three.tolist()} == grams
    # a model too large to broadcast is mapped from a file
    assert {r["doc_id"]: r["restored_h"] for r in M.find_garbled(df, model_bytes=0).collect()} == got


def test_probabilities():
    """Smoothed as published: what is left by the kinds seen goes to the shorter context."""
    import numpy as np

    texts = ["éa", "éab", "ñé"]
    keys, n = np.unique(M._codes(texts)[0], return_counts=True)
    model = M.CharModel(keys, n)
    grams = [f"  {t} "[i : i + 3] for t in texts for i in range(len(t) + 1)]

    def p(g):
        ones = [x[2] for x in grams]
        q = 0.95 * ones.count(g[2]) / (len(grams) + 1) + 0.05 / (len(grams) + 1)
        for k in (1, 2):
            after = [x[2] for x in grams if x[2 - k : 2] == g[2 - k : 2]] if k == 2 else [x[2] for x in grams if x[1] == g[1]]
            if after:
                q = (after.count(g[2]) + len(set(after)) * q) / (len(after) + len(set(after)))
        return q

    tokens = ["éab", "xé", "ñab"]
    score, strange = model.scores(*M._characters(tokens))
    assert np.allclose(score, [sum(np.log(p(f"  {t} "[i : i + 3])) for i in range(len(t) + 1)) for t in tokens])
    assert strange.tolist() == [0, 1, 0]


def test_suspects_are_all_that_change(restorer, records):
    """Summing many texts at once leaves out none that would be restored."""
    bad = [c.garble(r) for c in M.all_chains()[:12] for r in records[5:240:40]]
    texts = [x for x in [*records, *bad, f"{records[0]}\n{bad[0]}", f"{records[1]} {bad[3]}. {records[2]}"] if not x.isascii()]
    assert restorer.restore_all(texts) == {k: y for k, x in enumerate(texts) for y in [restorer.restore(x)] if y != x}


def test_validated_on_all_lines(spark, records):
    """Every clean line is judged, as it is and garbled by every chain that can be undone on it, by a model that hasn't seen its text."""
    chains = M.all_chains()
    texts = [r for r in records if not r.isascii()] + ["été déjà\nplain\nà côté"]
    lines = M.lines_of(spark.createDataFrame([(r,) for r in texts], "text string").repartition(3), lambda: lambda x: x)
    counts = M.trigram_counts(lines)
    models = [M.collected(counts, n) for n in (M.F.col("n") - M.F.col("n0"), M.F.col("n0"))]
    seen = [{s[i : i + 3] for r in texts if M.half(r) != k for t in r.split() if not t.isascii() for s in [f"  {t.lower()} "] for i in range(len(s) - 2)} for k in (0, 1)]
    assert [{chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in m.three.tolist()} for m in models] == seen
    got = M.verdicts(lines, [M.Shared(spark, M.Restorer(m, 0.0)) for m in models], 40)
    judges = [M.Restorer(m, 0.0) for m in models]
    for i, c in [(-1, None), *list(enumerate(chains))[::5]]:
        bad = [(M.half(r), y) for r in texts for x in r.split("\n") if not x.isascii() for y in [c.garble(x) if c else x] if not c or (y != x and c.fix(y) == x)]
        assert (i in got) == bool(bad)
        if bad:
            over = [sum(judges[k].best(y)[0] > m for k, y in bad) for m in M.MARGIN_GRID]
            assert got[i][1] == len(bad) and got[i][0][M.STRANGE_GRID.index(M.FIRST_STRANGE)].tolist() == over
    assert got[-1][1] == sum(not x.isascii() for r in texts for x in r.split("\n"))


def test_many_tokens_at_once(records):
    """Chains and gains of a whole row of tokens are those of each token; a line that is there several times is judged once and counts as often."""
    import numpy as np

    tokens = sorted({t for r in records for t in r.split() if not t.isascii()} | {"複製は19:36まで古いままです。", "请比较urzelsby中迟到的副本", "a\x93b", "é\x85", "😀été"})
    keys, n = np.unique(M._codes(tokens[::2])[0], return_counts=True)
    restorer = M.Restorer(M.CharModel(keys, n), 0.0)
    made = sorted({y for c in restorer.chains for t in tokens[::3] for y in [c.garble(t)] if y} | set(tokens))
    for c in restorer.chains:
        assert M.undone(c, made) == [c.fix(y) for y in made]
    gains, more = restorer.learnt(made)

    def score(texts):
        of, odd = restorer.model.scores(*(x if k else M.folded(x).astype(np.int64) for k, x in enumerate(M._characters(texts))))
        return of.sum(), odd

    for i, c in enumerate(restorer.chains):
        for k in range(i % 7, len(made), 7):
            y, new = made[k], c.fix(made[k])
            letters = not isinstance(c, (M.Swapped, M.Multibyte)) or any(x.isalpha() for x in y if x > "\x7f") or re.search(r"[^\W\d_][\x80-\x9f][^\W\d_]", y)
            (was, odd), (now, added) = score([y]), score([new])
            extra = min(max(int(added[0] - odd[0]), 0), 255) if new != y and letters else 0
            gain = now - was - restorer.strange * extra if new != y and letters else 0.0
            assert more[k, i] == extra and abs(gains[k, i] - gain) < 1e-3, (c.name, y, new)
    at, size = np.arange(len(tokens)), np.ones(len(tokens), np.int64)
    many = list(M.judged(restorer, tokens, np.concatenate([at, at, at]), np.concatenate([size] * 3), np.concatenate([size] * 3)))
    once = list(M.judged(restorer, tokens, at, size, 3 * size))
    assert [(i, k, over.tolist()) for i, over, k in many] == [(i, k, over.tolist()) for i, over, k in once]
