"""Stems by literal words, ROUGE on stems against plain Python, token arrays, the seeded split."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions import stems
from newsloom.plans import evaluation as ev
from newsloom.plans import training

SF = "/root/testdata/sf0.001"
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll a a is is""".split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    assert stems.stem(word) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def f1(hits, p, r):
    return 0.0 if not hits else 200 * hits / (p + r)


def test_training_rouge(spark):
    rows = ev.samples(spark, SF).select("language", "model", "reference_summary", "generated_summary").collect()
    words = lambda t: [stems.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())]
    sums = {}
    for r in rows:
        a, b = words(r.reference_summary), words(r.generated_summary)
        grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n)), strict=False))
        out = [f1((grams(a, n) & grams(b, n)).total(), max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)]
        sums.setdefault((r.language, r.model), []).append([*out, f1(lcs(a, b), len(a), len(b)), len(b)])
    got = training.m18_training_rouge(spark, SF).collect()
    assert len(got) == len(sums)
    for r in got:
        want = [sum(x) / len(x) for x in zip(*sums[r.language, r.model], strict=True)]
        assert [r.rouge1, r.rouge2, r.rougeL, r.gen_len] == pytest.approx(want, abs=1e-4)


def test_token_arrays(spark):
    df = spark.createDataFrame([(1, [5, 6, 7, 8, 9]), (2, [5]), (3, [])], "i int, ids array<int>")
    ids = stems.truncated(F.col("ids"), 4, 2)
    got = df.select("i", ids.alias("t"), stems.padded(ids, 4, 1).alias("p"), stems.mask(ids, 4).alias("m"), stems.labels(ids, 4, 1).alias("l"), stems.readable(stems.labels(ids, 4, 1), 1).alias("r"), stems.length(stems.padded(ids, 4, 1), 1).alias("n"), stems.truncated(F.col("ids"), 2).alias("c")).orderBy("i").collect()
    assert [(r.t, r.p, r.m, r.l, r.r, r.n, r.c) for r in got] == [
        ([5, 6, 7, 2], [5, 6, 7, 2], [1, 1, 1, 1], [5, 6, 7, 2], [5, 6, 7, 2], 4, [5, 6]),
        ([5, 2], [5, 2, 1, 1], [1, 1, 0, 0], [5, 2, -100, -100], [5, 2, 1, 1], 2, [5]),
        ([2], [2, 1, 1, 1], [1, 0, 0, 0], [2, -100, -100, -100], [2, 1, 1, 1], 1, []),
    ]


def test_seeded_split(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    a, b = (training.seeded_split(d, "k").where("split = 'validation'") for d in (rows, rows.where("k % 2 = 0").repartition(7)))
    assert 1800 < a.count() < 2200 and b.subtract(a).count() == 0 and a.where("k % 2 = 0").count() == b.count()
    assert training.seeded_split(rows, "k", seed=1).where("split = 'validation'").intersect(a).count() < 400
