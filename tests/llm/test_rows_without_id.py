"""Near duplicates where rows have no id: they are linked, links lead through them, and the stage drops them."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

from lodestone.llm.jaccard_join import keep_first, near_duplicates  # noqa: E402

KIND = "doc_id long, text string"


def changed(text, *at):
    words = text.split()
    for i in at:
        words[i] = f"changed{i}"
    return " ".join(words)


LONG = " ".join(f"word{i}" for i in range(120))


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_near_copy_without_id(spark):
    docs = spark.createDataFrame([(1, LONG), (None, changed(LONG, 60)), (None, "quite another text that nobody copies")], KIND)
    assert rows(near_duplicates(docs)) == [("1", 118, "1"), ("None", 4, "None"), ("None", 118, "1")]
    assert sorted((str(r.doc_id), r.text) for r in keep_first(docs, 3, 100, 90).collect()) == [("1", LONG), ("None", "quite another text that nobody copies")]


def test_links_lead_through_a_row_without_id(spark):
    far = changed(LONG, 30, 90)
    # the ends are too far apart for a link of their own: 109 of 127 shingles are common
    docs = spark.createDataFrame([(3, LONG), (None, changed(LONG, 30)), (1, changed(far, 60))], KIND)
    direct = {r.doc_id: r.component_id for r in near_duplicates(docs.where("doc_id is not null")).collect()}
    assert direct == {3: 3, 1: 1}
    between = spark.createDataFrame([(3, LONG), (None, far), (1, changed(far, 60))], KIND)
    assert {str(r.component_id) for r in near_duplicates(between).collect()} == {"1"}
    assert [(r.doc_id, r.text) for r in keep_first(between, 3, 100, 90).collect()] == [(1, changed(far, 60))]


def test_group_without_any_id(spark):
    docs = spark.createDataFrame([(None, LONG), (None, LONG), (None, LONG.upper()), (None, changed(LONG, 60)), (None, ""), (None, None)], KIND)
    assert {r.component_id for r in near_duplicates(docs).collect()} == {None}
    kept = [r.text for r in keep_first(docs, 3, 100, 90).collect()]
    full = [t for t in kept if t]
    assert sorted(t or "" for t in kept if not t) == ["", ""] and len(set(full)) == 1 and len(full) == (2 if full[0] == LONG else 1)


def test_components_against_brute_force(spark):
    """Every third row loses its id: components are those of the same rows with ids, under their least remaining id."""
    docs = C.awkward(40)
    full = C.near_duplicates(docs)
    lost = {i for k, (i, _) in enumerate(docs) if k % 3 == 0}
    least = {}
    for i, (_, g) in full.items():
        if i not in lost:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(None if i in lost else i), n, str(least.get(g))) for i, (n, g) in full.items())
    table = spark.createDataFrame([(None if i in lost else i, t) for i, t in docs], KIND)
    # a row without words is its own, and without id it has none
    assert rows(near_duplicates(table)) == want
