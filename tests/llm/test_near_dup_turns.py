"""How many turns near-duplicates take, and that their components are those of all pairs."""

import os
from random import Random

import pytest

from changeflow.llm import common, components, near_dup


def unlinked_and_copies():
    """Texts that share many bands and no link, some with near copies, and with rows of the same doc_id."""
    r = Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base + [f"x{d}y{k}" for k in range(54)]) for d in range(110)]
    texts += [texts[r.randrange(110)] + f" more {k}" for k in range(12)] + [texts[3], None, "", "short one"]
    return [(200 + k if k % 3 else k, t) for k, t in enumerate(texts)] + [(0, texts[9]), (0, texts[40]), (None, texts[5])]


def by_all_pairs(rows):
    """{doc_id: component_id}."""
    sets = [(d, set(near_dup.shingles(t).tolist())) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if c == high else c for d, c in root.items()}
    return root


def found(spark, rows):
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(v.kept == (v.doc_id in (None, v.component_id)) for v in out)
    return {v.doc_id: v.component_id for v in out if v.doc_id is not None}


def test_members_without_links_take_few_turns(spark, monkeypatch):
    written, names = common._written, []
    monkeypatch.setattr(common, "_written", lambda df, path: (names.append(os.path.basename(path).split("-")[0]), written(df, path))[1])
    rows = unlinked_and_copies()
    assert found(spark, rows) == by_all_pairs(rows)
    assert names.count("pairs") <= 3 and len(names) <= 30


@pytest.mark.parametrize("most", [1, 7])
def test_buckets_of_more_members_than_hubs(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "HUBS_MOST", most)
    monkeypatch.setattr(components, "EDGES", 5)
    rows = [x for k, x in enumerate(unlinked_and_copies()) if k % 8 == 0 or k > 105][:: 1 if most > 1 else 3]
    assert found(spark, rows) == by_all_pairs(rows)


def test_links_of_a_later_turn_join_components(spark):
    """A chain of near copies: many links that no one hub has."""
    words = [f"c{k}" for k in range(400)]
    rows = [(900 - 7 * k, " ".join(words[6 * k:6 * k + 100])) for k in range(40)]
    got = found(spark, rows)
    assert got == by_all_pairs(rows) and len(set(got.values())) < 8
