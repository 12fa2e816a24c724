"""HTML papers, cache rows, stored blocks."""

from pyspark.sql import functions as F

from foliant.operators import editing as E
from foliant.sources import documents as D
from foliant.sources import html as H
from foliant.sources import papers as PA


def test_papers_by_depth():
    """The abstract ends with its own element, numbers belong to open tables, other elements of those classes don't count."""
    html = """<section><div class="ltx_abstract x"><h6 class=t>Abstract</h6><div><p>We show <math alttext="a &lt; b" display="inline"><mi>a</mi></math>,<br>and <b>mo</b>re.</p></div>
      <p>Second.</p></div><p>Body.</p></section><div class="ltx_abstract">Another</div>
      <table class="ltx_equation ltx_eqn_table" id="E1"><tr><td><table class="ltx_equation ltx_eqn_table" id="in"><tr><td>x</td></tr></table><math alttext="y">y</math></td><td><span class="ltx_tag ltx_tag_equation ltx_align_right">(<b>3.1</b>)</span></td></tr></table>
      <span class="ltx_tag_equation">(99)</span><table class="ltx_eqn_table"><tr><td><span class="ltx_tag_equation">(5)</span></td></tr></table>
      <table id="E2" class="ltx_eqn_table ltx_equation"><tr><td>z</td></tr></table><table class="ltx_equation ltx_eqn_table"><tr><td><span class="ltx_tag_equation">(a-b)</span>"""
    assert PA.read(html) == (r"We show \(a < b\), and more. Second.", [("E1", "3.1"), ("E2", ""), ("", "")])
    assert PA.read(None) == PA.read("") == ("", [])
    assert PA.read("<div class=ltx_abstract><script>x</script><p>open <i>end")[0] == "open end"
    assert PA.read('<div class=ltx_abstract>a<math display="block" alttext="b"><mtext>c<p>d</p></mtext></math>e</div>')[0] == r"a\[b\]e"


def test_references_with_versions(spark):
    cases = [("1706.03762", "1706.03762", ""), (" 1706.03762v5 ", "1706.03762", "v5"), ("https://arxiv.org/pdf/2405.04434v2.pdf", "2405.04434", "v2"), ("math.GT/0309136", "math.GT/0309136", ""), ("hep-th/9901001v3", "hep-th/9901001", "v3"), ("nothing 12.3", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, id string, version string")
    for r in df.select("*", H.paper_ref_parts(F.col("c")).alias("r")).collect():
        assert (r.r.id, r.r.version) == (r.id, r.version) if r.r else r.id is None, r


def test_only_the_folder_of_a_cache_row_changes(spark):
    rows = [(1, '{"a":[1,{"dir":"/old/x"}],"dir":"/old/x/\\"y\\"","n":1.50,"z":null,"s":"é"}'), (2, '{"dir":"/older"}'), (3, '{"other":"/old"}'), (4, "no json /old"), (5, None), (6, '{"dir":"/old"}'), (7, '{"dir":{"dir":"/old"}}')]
    got = {r.key: r.value for r in E.repointed(spark.createDataFrame(rows, "key int, value string"), "/old", "/new").collect()}
    import json

    assert json.loads(got[1]) == json.loads(rows[0][1]) | {"dir": '/new/x/"y"'}
    assert json.loads(got[6]) == {"dir": "/new"}
    assert all(got[k] == v for k, v in rows if k not in (1, 6))


def test_stored_blocks_know_their_buckets(spark, tmp_path):
    blocks = spark.createDataFrame([(p, k, f"b-{k}", "x") for p in range(30) for k in range(3)], "paper_id long, ord long, id string, en string")
    path = str(tmp_path / "blocks")
    D.save_blocks(blocks, path, 7)
    D.save_blocks(blocks.where("paper_id = 4 and ord < 2"), path)  # another default: the table keeps its own
    assert [r.id for r in D.load_blocks(spark, path, 4).collect()] == ["b-0", "b-1"]
    assert D.load_blocks(spark, path, 5).count() == 3 and D.load_block(spark, path, 5, "b-2").count() == 1
    assert spark.read.parquet(path).count() == 89
    plan = D.load_blocks(spark, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
