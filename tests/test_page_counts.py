from datetime import datetime, timezone

import pytest

import __spark_entry__

PAGES = "id long, site_id int, url string, title string, h1 string, content string, og_title string, og_description string, og_image_url string, jsonld string, pagerank_score double, click_score double, tracker_risk_score double, last_crawled_at timestamp"
JOBS = "job_id string, url string, domain string, status string, title string, word_count int, internal_links_count int, external_links_count int, content string, started_at timestamp, completed_at timestamp"


def test_page_value_by_the_counts_of_the_latest_job(spark, tmp_path):
    def job(name, url, status, internal, external, html, day):
        at = datetime(2022, 1, day, tzinfo=timezone.utc)
        return (name, url, "e.com", status, "t", 1, internal, external, html, at, at)

    urls = [f"https://e.com/forum/{k}" for k in range(4)]
    pages = [(k, 1, url, *[None] * 11) for k, url in enumerate(urls)]
    jobs = [
        job("a", urls[0], "completed", 4, 6, "<h1>x</h1><H2 class='y'>z</H2><h3>w</h3><head><hr>", 3),
        job("b", urls[0], "completed", 90, 900, None, 2),
        job("c", urls[0], "failed", 0, 0, None, 9),
        job("d", urls[1], "pending", 50, 50, None, 3),
        job("e", urls[2], " Completed", None, 1000, None, 3),
        job("e", urls[2], " Completed", None, 1000, None, 3),
    ]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(jobs, JOBS).write.parquet(f"{tmp_path}/crawl_jobs.parquet")
    got = {r.id: r for r in __spark_entry__.queries()["page_value"](spark, str(tmp_path)).collect()}
    assert len(got) == 4
    # depth 2: 85; links and backlinks: 75 and 70, none, 20 and 86, none
    assert [got[k].link for k in range(4)] == pytest.approx([(85 + p + b) / 3 for p, b in ((75, 70), (20, 30), (20, 86), (20, 30))], abs=1e-6)
    assert [got[k].content for k in range(4)] == [68, 65, 65, 65]  # articles with three headings and none
