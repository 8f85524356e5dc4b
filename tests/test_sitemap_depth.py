from siftworks.sources import sitemap


def test_sitemaps_nested_deeper_than_three_and_in_circles(spark):
    def xml(k):
        return f"<sitemapindex><sitemap><loc>s{k + 1}</loc></sitemap><sitemap><loc>s1</loc></sitemap><url><loc>p{k}</loc></url></sitemapindex>"

    maps = spark.createDataFrame([(f"s{k}", xml(k)) for k in range(7)], "url string, xml string")
    roots = maps.where("url = 's0'")
    assert {r.loc for r in sitemap.expanded(roots, maps).collect()} == {f"p{k}" for k in range(7)}
    assert {r.loc for r in sitemap.expanded(roots, maps, rounds=2).collect()} == {"p0", "p1", "p2"}
    assert sitemap.expanded(roots, maps.limit(0)).count() == 1
