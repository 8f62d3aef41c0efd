"""A small linkage problem from sources to a validated submission."""

import random

from kinfold.plans import linkage as lk
from kinfold.sources.tables import TRUTH, read_tsv

WORDS = "alpha bravo canyon delta ember falcon garnet harbor indigo jasper kernel lagoon marble nectar orchid pepper quartz raven saffron timber".split()


def sources(folder, split, n, seed):
    rng, rows, truth = random.Random(seed), {1: [], 2: [], 3: []}, []
    for i in range(n):
        country = rng.choice(["US", "India"])
        name = " ".join(rng.sample(WORDS, 3)) + f" {rng.choice(['Inc', 'Ltd', 'LLC'])}"
        address = f"{rng.randrange(1, 999)} {rng.choice(WORDS)} street {rng.randrange(10000, 99999)}"
        rows[1].append((f"S1-{i}", name, address, country))
        own = []
        for src in (2, 3):
            for c in range(rng.randrange(0, 3)):
                rid = f"S{src}-{i * 10 + c}"
                words = name.split()
                rng.shuffle(words)
                rows[src].append((rid, " ".join(words), address if rng.random() < 0.8 else "", country))
                own.append(rid)
        truth.append((f"S1-{i}", ",".join(own)))
    for src in (2, 3):
        rows[src] += [(f"S{src}-9{j:04}", " ".join(rng.sample(WORDS, 3)), f"{j} {rng.choice(WORDS)} road", "US") for j in range(n // 5)]
    d = folder / split
    d.mkdir(parents=True)
    for src, r in rows.items():
        (d / f"{split}_source{src}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x) + "\n" for x in r))
    if split == "train":
        (d / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    return truth


def test_run(spark, tmp_path):
    sources(tmp_path / "d", "train", 150, 1)
    hidden = sources(tmp_path / "d", "test", 60, 2)
    data, out = str(tmp_path / "d"), str(tmp_path / "o")
    f, ents = lk.build(spark, data, out, "train", max_df=0.5)
    assert ents.count() == 150 and f.where("label = 1").count() > 0.9 * ents.agg({"k": "sum"}).first()[0]
    rules = lk.train(spark, data, out, folds=(0, 1), kind="forest")
    assert rules["threshold"]["report"] > 0.75
    lk.build(spark, data, out, "test", max_df=0.5)
    meta = lk.predict(spark, data, out, "first")
    assert meta["warnings"] == [] and meta["match_pairs"] > 0
    got = {r[0]: set(filter(None, r[1].split(","))) for r in read_tsv(spark, f"{out}/submissions/first/matching", TRUTH, quoted=False).collect()}
    want = {a: set(filter(None, b.split(","))) for a, b in hidden}
    assert got.keys() == want.keys() and sum(len(got[k] & want[k]) for k in want) > 0.7 * sum(map(len, want.values()))
    assert lk.compare(spark, out, out)["delta"] == 0 and lk.profile(spark, out).count() == 2
    assert 0 <= lk.stress(spark, out)["stressed"] <= 1 and lk.folds_report(spark, data, out).count() > 0
