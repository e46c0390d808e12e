"""What the near-dedup stage compares: SimHash decides what is left to the prefix filter, and copies don't meet in all pairs."""

import random

from glotta.llm import jaccard


def near_copies(n, words, changed, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    texts = {}
    for k in range(n):
        new = list(base)
        for _ in range(rng.choice(changed)):
            new[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        texts[k + 1] = " ".join(new)
    return texts


def worked(monkeypatch, spark, texts):
    """Rows of the tables that the stage writes on the way, by name, and the component of each document."""
    sizes = {}

    def parts(rows, name, write=jaccard.materialise_parts):
        found = write(rows, name)
        sizes.setdefault(name, []).append(found.count())
        return found

    with monkeypatch.context() as m:
        m.setattr(jaccard, "materialise_parts", parts)
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        rows = jaccard.near_duplicates(docs).collect()
    return sizes, {r["doc_id"]: r["component"] for r in rows}


def same_groups(a, b):
    return len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


def test_simhash_decides_what_the_prefix_filter_reads(spark, monkeypatch):
    texts = near_copies(20, 1500, [1]) | {100 + k: t for k, t in near_copies(10, 1500, [1], 6).items()}
    with_it, groups = worked(monkeypatch, spark, texts)
    with monkeypatch.context() as m:
        m.setattr(jaccard, "_proposed", lambda *args: spark.createDataFrame([], "a bigint, b bigint"))
        without, same = worked(monkeypatch, spark, texts)
    assert with_it["jaccard-members"][0] < without["jaccard-members"][0] / 2
    assert same_groups(groups, same)


def test_near_copies_of_different_distance_make_few_pairs(spark, monkeypatch):
    sizes, groups = worked(monkeypatch, spark, near_copies(300, 150, [1, 2, 3, 4, 5, 6]))
    assert len(set(groups.values())) > 1  # some have too many words changed
    assert sum(sizes["jaccard-apart"]) < 300 * 10
