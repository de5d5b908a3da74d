from leaguelens.llm import near_copies, simhash
from tests.llm.frames import documents, multiset

A = "the cat sat on the mat and looked at the moon for a long time tonight"
B = "a wholly different text of some other words that nobody has copied yet"
C = "and a third one about ships and harbours and the weather of the north"


def _check(spark, one_of_each):
    rows = [(3, A), (7, A), (7, B), (7, B), (9, C), (None, "one text without an id but with words of its own"), (None, "and here is a second such text, quite unlike it"), (None, C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(3, A), (7, B), (9, C), rows[5], rows[6]]
    assert multiset(map(tuple, one_of_each(docs).collect())) == multiset(want)


def test_near_copies_keep_every_group_whatever_its_ids(spark):
    _check(spark, near_copies.one_of_each)


def test_near_fingerprints_keep_every_group_whatever_its_ids(spark):
    _check(spark, simhash.one_of_each)


def test_odd_rows_stay_once_with_all_columns(spark):
    docs = documents(spark)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and near_copies.one_of_each(docs.limit(0)).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 5, 6, 8, 9] and ids.count(None) == 1
