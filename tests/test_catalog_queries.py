import pytest
from cataloom.plans import more, queries as Q, remote, rules, sources, streams, upkeep  # noqa: F401

from compare import both, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_equal_those_of_the_sql(spark, duck, name):
    mine, theirs = both(spark, duck, Q.REGISTERED[name], Q.SQL[name], SF)
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
    assert mine[1] or name in ("adu_growth", "adu_shrink")


def test_references_in_titles_are_those_of_the_sql(spark, tmp_path):
    titles = ["a &amp;&amp", "&amp;lt; &lt;b&gt;", "\n a  b&#39;s &quot;c&quot; ", "&nbsp;&copy x", "A&T &amp b", "", "&amp", "ü&ltü"]
    pages = [(i, "u", f"<html><title lang='&amp'>{x}</title><script>'&amp'</script><h1 id='&lt'>{x}</h1><H1>y</H1>") for i, x in enumerate(titles)]
    spark.createDataFrame([*pages, (90, "u", None), (91, "u", ""), (92, "u", "<p>&amp")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    mine, theirs = both(spark, connection(str(tmp_path)), Q.REGISTERED["page_outline"], Q.SQL["page_outline"], str(tmp_path))
    assert mine == theirs and len(mine[1]) == 11
