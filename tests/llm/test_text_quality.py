"""Scan noise, residue, cut values and personal mentions on small made-up tables."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lumenfig.llm import cut_text, page_noise, pii, residue
from lumenfig.llm.boosting import Boosted
from lumenfig.llm.pii_seeds import labelled

NAMES = ["Tabor", "Melvin", "Kestrova", "Orlun", "Pravik", "Sundel", "Varnis", "Holt"]
WORDS = ["coarse", "spectral", "capture", "figure", "linear", "neural", "marginal", "coverage"]


def _captions(n=400):
    rng = np.random.default_rng(1)
    return [f"Figure {i}: The {WORDS[rng.integers(8)]} reward of {NAMES[rng.integers(8)]} shows a {WORDS[rng.integers(8)]} and {WORDS[rng.integers(8)]} loss with pre- and post-tuning on {NAMES[rng.integers(8)]}." for i in range(n)]


def test_page_noise(spark):
    base = _captions()
    head = "Journal of Invented Results 12 (2040) 33–48"
    dirty = {
        1: base[1].replace("shows a ", f"shows a \n{head}\n "), 2: base[2].replace("reward", "rewa-\nrd"), 3: base[3].replace("reward", "re\xadward"), 4: base[4].replace("reward", "rcward"), 5: base[5].replace("reward", "rew4rd"),
        6: base[6] + " \n\n37", 7: base[7].replace("shows", "[p. 12] shows"), 8: base[8].replace("loss with", f"loss {head.replace('12', '13')} with"), 9: base[9].replace("figure", "ﬁgure").replace("and ", "and - 4 - "),
    }
    more = [b.replace("shows a ", f"shows a \n{head}\n ") for b in base[20:30]]
    rows = [(i, dirty.get(i, b)) for i, b in enumerate(base)] + [(1000 + i, b) for i, b in enumerate(more)] + [(2000, None), (2001, ""), (2002, "Well-known pre- and post-war Größe, état."), (2003, "word " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_id LONG, caption STRING, text STRING")
    got = {r["key"]: r for r in page_noise.repaired(df, "rec_id", F.col("caption")).collect()}
    assert len(got) == len(rows) and got[2000]["text"] is None
    assert {k for k, r in got.items() if r["traces"]} == set(dirty) | {1000 + i for i in range(10)}
    for i in (1, 2, 3, 4, 5, 6, 7, 8):
        assert got[i]["text"].replace("  ", " ") == base[i], i
    assert page_noise.repaired(df.limit(0), "rec_id", F.col("caption")).count() == 0


def test_lines_that_repeat_nothing_stay(spark):
    probes = ["We compare the output of\nGraph Transformer\nwith earlier work.", "Results of the\nU-Net Encoder (ours)\nare shown.", "Accuracy for\n2019\nand 2020 is shown.", "Results for all classes. 17", "Figure 4b: The loss of panel 6a."]
    df = spark.createDataFrame(list(enumerate(probes + _captions(50))), "rec_id LONG, caption STRING")
    got = {r["key"]: r for r in page_noise.repaired(df, "rec_id", F.col("caption")).collect()}
    for i, text in enumerate(probes):
        assert got[i]["text"] == text.replace("\n", " ") and got[i]["traces"] == [], text


def test_heads_of_a_thousand_journals(spark):
    rng = np.random.default_rng(4)
    syllables = ["tor", "vel", "mik", "dra", "sun", "pol", "kes", "lin", "bru", "fam"]
    base = _captions(400)
    rows, heads = [(i, "s0", t) for i, t in enumerate(base)], {}
    for j in range(1000):
        name = " ".join("".join(rng.choice(syllables, 3)).capitalize() for _ in range(3))
        for k in range(5):
            heads[1000 + 5 * j + k] = base[(5 * j + k) % 400].replace("shows a ", f"shows a \nAnnals of {name} {j % 90 + 1} ({2030 + k}) {k}{j % 10}–{k + 40}\n ")
    rows += [(i, f"s{i % 7}", t) for i, t in heads.items()]
    df = spark.createDataFrame(rows, "rec_id LONG, collector STRING, caption STRING")
    got = {r["key"]: r for r in page_noise.repaired(df, "rec_id", F.col("caption"), F.col("collector")).collect()}
    assert all(got[i]["traces"] == ["running head"] and got[i]["text"] == base[(i - 1000) % 400] for i in heads)
    assert all(got[i]["traces"] == [] for i in range(400))


def test_bare_numbers_in_sequence_are_pages(spark):
    base = _captions(60)
    rows = [(i, "a", f"{t} {20 + i}") for i, t in enumerate(base[:8])] + [(20 + i, "b", t + (f" {7 * i * i + 3}" if i < 8 else "")) for i, t in enumerate(base[20:])] + [(90, None, base[8] + " 23")]
    df = spark.createDataFrame(rows, "rec_id LONG, collector STRING, caption STRING")
    got = {r["key"] for r in page_noise.repaired(df, "rec_id", F.col("caption"), F.col("collector")).where("size(traces) > 0").collect()}
    assert got == set(range(8))


def test_misreading_in_a_third_of_the_rows(spark):
    base = _captions()
    rows = list(enumerate(base)) + [(1000 + i, base[4].replace("reward", "rcward")) for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id LONG, caption STRING")
    got = {r["key"]: (r["text"], r["traces"]) for r in page_noise.repaired(df, "rec_id", F.col("caption")).collect()}
    assert all(got[1000 + i] == (base[4], ["misread characters"]) for i in range(200))
    assert all(got[i] == (t, []) for i, t in enumerate(base))


def test_very_long_words_are_not_searched():
    repair = page_noise.Repair({"memory": 50, "reward": 40}, set(), [], []).prepare()
    for unit in ("c", "l1", "rnvv"):
        long = unit * (600 // len(unit))
        tracemalloc.start()
        got = repair(f"The {long} of rcward and mernory.")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == (f"The {long} of reward and memory.", ["misread characters"]) and peak < 20e6, (unit, peak)


def test_residue(spark):
    good = [f"A {w} chart shows how {n} changes with {v} over 20 settings." for w in WORDS for n in NAMES for v in WORDS]
    bad = ["Please enable JavaScript to view this content.", "503 Service Unavailable", "Lorem ipsum dolor sit amet, consectetur elit sed magna.", "A {{ title }} of loss for Tabor.", "The figure shows [INSERT CAPTION] and ____.", "placeholder placeholder", "xxxxx xxxxx xxx", "A chart of %topic% with Holt."]
    fair = ["The chart lists error messages of the Tabor gateway and the retries that follow.", "A line chart while labels in {0, 1} are flipped."]
    rows = [(i, t, None, None) for i, t in enumerate(good * 3)] + [(5000 + i, None, t, [good[0], t]) for i, t in enumerate(bad)] + [(6000 + i, t, t, [t]) for i, t in enumerate(fair * 30)] + [(7000, None, "", []), (7001, " ", None, [None, ""])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_id LONG, description2 STRING, description3 STRING, questions ARRAY<STRING>, key INT")
    got = {(r["key"], r["field"]) for r in residue.residue(df, "rec_id", ["description2", "description3", "questions"]).collect()}
    assert got == {(5000 + i, f) for i in range(len(bad)) for f in ("description3", "questions")}
    assert residue.residue(df.limit(0), "rec_id", ["description2", "questions"]).count() == 0


def test_values_never_set(spark):
    good = [f"A {w} chart shows how {n} changes with {v} over 20 settings." for w in WORDS for n in NAMES for v in WORDS]
    fair = ["The ratio is undefined where the loss is zero.", "Undefined behaviour of the linker shows as a gap.", "The plot counts undefined references per module."]
    bad = ["A coarse chart undefined how Tabor changes.", "What role does undefined capture play in the layout of Holt?", "A linear chart joined by arrows around undefined"]
    df = spark.createDataFrame(list(enumerate(good * 3 + fair + bad)), "rec_id LONG, description2 STRING")
    first = 3 * len(good) + len(fair)
    assert {r["key"] for r in residue.residue(df, "rec_id", ["description2"]).collect()} == set(range(first, first + len(bad)))


def test_residue_that_is_frequent(spark):
    good = [f"A {w} chart shows how {n} changes with {v} over {k} settings." for w in WORDS for n in NAMES for v in WORDS for k in ("20", "thirty")]
    same = "JavaScript is disabled in your browser."
    rows = [(i, t) for i, t in enumerate(good)] + [(5000 + i, same) for i in range(len(good) // 2)]
    rows += [(8000 + i, f"{t} Please enable JavaScript to view this content.") for i, t in enumerate(good[::2])]
    rows += [(9000 + i, "A {{ title }} of loss for Tabor.") for i in range(len(good) // 2)]
    df = spark.createDataFrame(rows, "rec_id LONG, description2 STRING")
    got = {r["key"] for r in residue.residue(df, "rec_id", ["description2"]).collect()}
    assert got == {i for i, _ in rows if i >= 5000}


def test_cut_text(spark):
    rng = np.random.default_rng(2)

    def text():
        return " ".join(f"The {WORDS[rng.integers(8)]} chart compares {WORDS[rng.integers(8)]} settings of {NAMES[rng.integers(8)]} with the {WORDS[rng.integers(8)]} reference." for _ in range(rng.integers(1, 4)))

    rows, cut = [], set()
    for i in range(3000):
        t, source = text(), "abc"[i % 3]
        if source == "a" and len(t) > 120:
            t = t[:120].rstrip()
            cut.add(i)
        elif i % 50 == 1:
            t = t[: len(t) // 2] + ("…" if i % 4 == 1 else "")
            cut.add(i)
        elif i % 40 == 3:
            t = f"Workflow of {NAMES[rng.integers(8)]} with {NAMES[rng.integers(8)]}"
        rows.append((i, source if i % 7 else None if source != "a" else "a", t))
    rows += [(9000, "a", None), (9001, "a", ""), (9002, None, "  ")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "rec_id LONG, collector STRING, caption STRING, size INT")
    hits = cut_text.cut_values(df, "rec_id", ["caption"], "collector", ["caption"])
    got = {r["key"] for r in hits.collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.05 * len(cut)
    shares = {r["source"]: r["n_cut"] for r in cut_text.cut_shares(df, hits, ["caption"], "collector").collect()}
    assert sum(shares.values()) == len(got)
    assert cut_text.cut_values(df.limit(0), "rec_id", ["caption"], "collector", ["caption"]).count() == 0


def test_boosted_trees_learn_a_rule():
    x = np.random.default_rng(0).normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    assert Boosted().fit(x, y).f1 > 0.95


def test_mentions_of_held_out_texts():
    models = pii.fit()
    texts = labelled(800, 99)
    right = said = true = 0
    for (_, spans), found in zip(texts, pii.mentions([t for t, _ in texts], models)):
        a = {k for k, _, _ in spans}
        b = {k for k, _, _ in found}
        right, said, true = right + len(a & b), said + len(b), true + len(a)
    assert right / said > 0.95 and right / true > 0.95


def test_redaction(spark):
    rows = [
        (1, "Contact: ana.marberg@mail.example.org or +44 7700 900123. See doi 10.0000/fig.435.43 and precision@10."), (2, "Ship the plates to Clara Norbridottir, 12 Birch Road, Velden."),
        (3, "Both TralfoixNet and Gakvek-7k read the caption first."), (4, None), (5, ""), (6, "Annotator payroll id QQ 12 34 56 C was left. " + "The model runs. " * 5000), (2, "Ship the plates to Clara Norbridottir, 12 Birch Road, Velden."),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id LONG, text STRING, kinds STRING")
    got = [(r["key"], r["text"], tuple(r["kinds"])) for r in pii.redacted(df, "doc_id", "text").collect()]
    of = {k: (t, s) for k, t, s in got}
    assert len(got) == len(rows) and of[4] == (None, ()) and of[5] == ("", ())
    assert of[1] == ("Contact: [EMAIL] or [PHONE]. See doi 10.0000/fig.435.43 and precision@10.", ("email", "phone"))
    assert of[2] == ("Ship the plates to [PERSON], [ADDRESS].", ("address", "person"))
    assert of[3][1] == () and of[6][1] == ("id_number",)
    assert pii.redacted(df.limit(0), "doc_id", "text").count() == 0
