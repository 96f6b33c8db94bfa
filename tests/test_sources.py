"""Paged sources, calls in flight, saved files, crawls, early stops."""

import json
import os
import random
import threading
import time
from collections import deque
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from litlake.operators import crawl, download, first, pdf
from litlake.sources import fetching, files, works

CALLS = os.environ.get("LITLAKE_TEST_CALLS", "/tmp/litlake-test-calls")


def fake_api(params):
    """Seven pages of three works for each request; every call leaves a line in a file."""
    with open(CALLS, "a", encoding="utf-8") as f:
        f.write(json.dumps(params, sort_keys=True) + "\n")
    page = 0 if params["cursor"] == "*" else int(params["cursor"])
    rows = [{"title": f"{params['filter'][-12:]} {page}.{i}", "doi": f"https://doi.org/10.1/{page}.{i}", "publication_year": 2024 - page, "cited_by_count": i} for i in range(3)]
    return json.dumps({"results": rows if page < 7 else [], "meta": {"next_cursor": str(page + 1)}})


def calls():
    with open(CALLS, encoding="utf-8") as f:
        return [json.loads(line) for line in f]


@pytest.fixture
def log():
    open(CALLS, "w").close()
    yield
    os.remove(CALLS)


FETCH = "tests.test_sources:fake_api"


def test_parameters():
    p = works.Seed("1234-5678", first_year=2001, last_year=2003).params("*", 50)
    assert p == {"filter": "primary_location.source.issn:1234-5678,type:article,from_publication_date:2001-01-01,to_publication_date:2003-12-31", "per-page": "50", "cursor": "*", "sort": "publication_date:desc"}
    p = works.Seed(search="ageing cells").params("x")
    assert p == {"filter": "type:article", "per-page": "200", "cursor": "x", "search": "ageing cells"}


def test_filters_and_limit_are_pushed(spark, log):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(works.WorksSource)
    seeds = json.dumps([{"issn": "1"}, {"search": "s"}])
    read = lambda **o: spark.read.format("works").options(seeds=seeds, fetch=FETCH, **o).load()
    assert read().count() == 42 and len(calls()) == 16
    open(CALLS, "w").close()
    got = read().where("publication_year >= 2020 AND publication_year < 2023 AND work LIKE '%.1%'").select("seed", "page", "place").collect()
    assert sorted({(r["page"], r["place"]) for r in got}) == [(p, i) for p in (2, 3, 4) for i in range(3)]
    assert all("from_publication_date:2020-01-01,to_publication_date:2022-12-31" in c["filter"] for c in calls())
    open(CALLS, "w").close()
    assert read(limit=4).count() == 8 and len(calls()) == 4 and {c["per-page"] for c in calls()} == {"4"}
    articles = works.articles_of(read(limit=3))
    assert articles.count() == 6 and articles.where("doi like '10.1/0.%'").count() == 6


def test_stream_goes_on_at_its_cursor(spark, log, tmp_path):
    spark.dataSource.register(works.WorksSource)

    def start(most):
        stream = spark.readStream.format("works").options(seeds=json.dumps([{"issn": "1"}]), fetch=FETCH).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while time.time() < end and q.isActive and not (q.lastProgress and spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select("page").distinct().count() >= most):
            time.sleep(0.1)
        q.stop()

    start(3)
    seen = len(calls())
    assert 3 <= seen < 8
    start(7)
    asked = [c["cursor"] for c in calls()]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["page"] for r in out.select("page").collect()) == [p for p in range(7) for _ in range(3)]
    # no page is read twice, but for one that was planned when the query stopped
    assert len(asked) - len(set(asked)) <= 1 and "*" not in asked[1:]


def test_in_flight_order_and_errors():
    lock, now, most = threading.Lock(), [0], [0]

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(random.random() / 200)
        with lock:
            now[0] -= 1
        if x % 7 == 3:
            raise ValueError(f"no {x}")
        return x * x

    drawn = []
    got = list(fetching.in_order((drawn.append(i) or i for i in range(60)), call, 4))
    assert got == [(None, f"ValueError: no {i}") if i % 7 == 3 else (i * i, None) for i in range(60)]
    assert 1 < most[0] <= 4
    ahead = fetching.in_order((drawn.append(i) or i for i in range(60)), call, 4)
    drawn.clear()
    next(ahead)
    assert len(drawn) <= 5
    ahead.close()


def test_pace():
    clock, slept = [0.0], []
    pace = fetching.Pace(2.0, lambda: clock[0], lambda s: slept.append(s) or clock.__setitem__(0, clock[0] + s))
    for host in ("a", "a", "b", "a"):
        pace.wait(host)
    assert slept == [2.0, 2.0]


def page_of(url):
    if url.endswith("3"):
        raise OSError("gone")
    return f"<{url}>"


def test_fetched_rows(spark):
    rows = [(i, f"h{i % 3}", None if i == 8 else f"u{i}", "extra") for i in range(40)]
    out = fetching.fetched(spark.createDataFrame(rows, "id long, host string, url string, body2 string"), "tests.test_sources:page_of", 3, tasks_of_host=2).collect()
    assert len(out) == 40
    for r in out:
        want = (None, "ValueError: no url") if r["id"] == 8 else (None, "OSError: gone") if r["url"].endswith("3") else (f"<{r['url']}>", None)
        assert (r["body"], r["error"]) == want and r["body2"] == "extra"
    assert fetching.fetched(spark.createDataFrame([], "id long, host string, url string"), "tests.test_sources:page_of").count() == 0


PDF = b"%PDF-" + b"Abstract " + b"x" * 300 + b" References"


def test_files_are_saved_once(spark, tmp_path):
    spark.dataSource.register(files.FilesSource)
    schema = "folder string, name string, content binary, other_names array<string>"
    rows = [("a/b", f"（2026，NA）Paper {i}（Smith，Institute）.pdf", bytearray(PDF), [f"10.1_{i}.pdf"]) for i in range(6)]
    rows += [("a/b", "small.pdf", bytearray(b"%PDF- abstract"), None), ("a/b", "page.pdf", bytearray(b"<html>" + PDF), None), ("a/b", "none.pdf", None, None), ("a/b", rows[0][1], bytearray(PDF), None)]
    out = tmp_path / "out"
    (out / "a/b").mkdir(parents=True)
    (out / "a/b" / "10.1_1.pdf").write_bytes(PDF + b"old")  # renamed to the final name
    (out / "a/b" / rows[2][1]).write_bytes(PDF + b"there")  # stays
    (out / "a/b" / "（2026，NA）Paper 2（Smith，Institute of.pdf").write_bytes(PDF)  # cut off elsewhere: goes
    df = spark.createDataFrame(rows, schema).repartition(3)
    for _ in range(2):
        df.write.format("paper_files").mode("append").options(path=str(out), least=100).save()
        assert sorted(os.listdir(out / "a/b")) == sorted({r[1] for r in rows[:6]})
        assert not os.listdir(out / files.PENDING)
    assert (out / "a/b" / rows[1][1]).read_bytes() == PDF + b"old" and (out / "a/b" / rows[2][1]).read_bytes() == PDF + b"there"


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(files.FilesSource)
    df = spark.range(6).select(F.lit("a").alias("folder"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("name"), F.when(F.col("id") < 5, F.lit(bytearray(PDF))).otherwise(F.raise_error(F.lit("stop")).cast("binary")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        df.write.format("paper_files").mode("append").options(path=str(tmp_path / "out"), least=100).save()
    assert [f for _, _, fs in os.walk(tmp_path / "out") for f in fs] == []


def one_by_one(web, seeds, limit=None):
    queue, seen, out = deque((u, 0, None) for u in dict.fromkeys(seeds)), set(dict.fromkeys(seeds)), []
    while queue and (limit is None or len(out) < limit):
        url, depth, parent = queue.popleft()
        out.append((url, depth, len(out), parent))
        for t in dict.fromkeys(web.get(url, [])):
            try:
                u = urldefrag(urljoin(url, t)).url
            except ValueError:
                continue
            if u.startswith("http") and u not in seen:
                seen.add(u)
                queue.append((u, depth + 1, url))
    return out


@pytest.mark.parametrize("limit", [None, 1, 7, 23, 1000])
def test_a_crawl_equals_one_that_goes_one_by_one(spark, limit):
    rng = random.Random(5)
    urls = [f"http://h{i % 4}.org/p/{i}" for i in range(60)]
    web = {u: [rng.choice([v, v, f"/p/{rng.randrange(80)}", f"../p/{rng.randrange(80)}#x", "mailto:me", "#top", "http://[bad", f"{rng.randrange(80)}"]) for v in rng.choices(urls, k=rng.randrange(4))] for u in urls}
    html = spark.createDataFrame([(u, "".join(f"<a class=x href='{t}'>t</a>" for t in ts)) for u, ts in web.items()], "url string, html string")
    seeds = [urls[3], urls[1], urls[3], "http://h9.org/none"]
    frame = spark.createDataFrame([*((u, i) for i, u in enumerate(seeds)), (None, 9), ("", 10)], "url string, place long")
    out = crawl.crawl(frame, lambda f: html.join(f, "url"), limit)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == one_by_one(web, seeds, limit)


def test_first_rows_read_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6400).repartitionByRange(64, "id").withColumn("ok", F.col("id") % 10 == 0).write.parquet(path)
    whole, n = first.first_of(spark, path, 10**6, F.col("ok"))
    want = sorted((r["_file"], r["_row"], r["id"]) for r in whole.collect())
    assert n == 64 and len(want) == 640
    for most, files_read in ((1, 1), (25, 3), (200, 31), (0, 0)):
        some, n = first.first_of(spark, path, most, F.col("ok"))
        assert sorted((r["_file"], r["_row"], r["id"]) for r in some.collect()) == want[:most] and n == files_read


def test_download_steps_end_as_files(spark, tmp_path):
    """The states of papers, then the files that they leave; a second run finds all of them there."""
    spark.dataSource.register(files.FilesSource)
    articles = [("Existing paper", "10.1/a"), ("Named after its DOI", "10.1/b"), ("Cut off elsewhere", "10.1/c"), ("New", "10.1/d"), ("Refused", "10.1/e"), ("Failed", "10.1/f"), ("Without address", "")]
    df = spark.createDataFrame([(i, "x/y", t, d, d and f"http://{d}", "2026-01-01", "Nature Aging", ["Smith, A."], ["Institute, City"]) for i, (t, d) in enumerate(articles)], "id long, folder string, title string, doi string, pdf_url string, publish_date string, journal string, authors array<string>, institutions array<string>").withColumn("name", pdf.file_name())
    out = tmp_path / "out"
    (out / "x/y").mkdir(parents=True)
    for n in ("（2026，NA）Existing paper（Smith，Institute）.pdf", "10.1_b.pdf", "（2026，NA）Cut off elsewhere（Smith，Institute of.pdf"):
        (out / "x/y" / n).write_bytes(PDF)
    answers = spark.createDataFrame([(3, bytearray(PDF), None), (4, bytearray(b"<html>" + PDF), None), (5, None, "OSError: gone"), (0, bytearray(b"never"), None)], "id long, content binary, error string")

    def run():
        there = spark.createDataFrame([("x/y", n) for n in os.listdir(out / "x/y")], "folder string, name string")
        rows = download.settled(download.planned(df, there), answers, least=100)
        download.to_save(rows).write.format("paper_files").mode("append").options(path=str(out), least=100).save()
        return [(r["download_status"], r["pdf_status"]) for r in rows.orderBy("id").collect()]

    rest = [("skipped", "not_pdf"), ("failed", "error"), ("skipped", "missing_pdf_url")]
    there = spark.createDataFrame([("x/y", n) for n in os.listdir(out / "x/y")], "folder string, name string")
    assert [r["step"] for r in download.planned(df, there).orderBy("id").collect()][:4] == ["skipped_existing", "skipped_existing_renamed", "skipped_existing_renamed", "fetch"]
    run()
    assert sorted(os.listdir(out / "x/y")) == sorted(f"（2026，NA）{t}（Smith，Institute）.pdf" for t, _ in articles[:4])
    assert run() == [("skipped_existing", "complete")] * 4 + rest


@pytest.mark.parametrize("name", ["（2026，NA）Paper（Smith，Institute）.pdf", "（2026，NA）" + "A long title " * 9 + "（x.pdf", "10.1_a.pdf", "（2026，NA）.pdf", "（2026，NA）a\nb.pdf", "", "x（y）.pdf"])
def test_variants_are_the_same_in_both_forms(spark, name):
    assert spark.range(1).select(download.variant_key(F.lit(name))).first()[0] == files.variant_key(name)


def test_saved_papers_are_filed_by_subdomain(spark, tmp_path):
    spark.dataSource.register(files.FilesSource)
    out = tmp_path / "out"
    (out / "x").mkdir(parents=True)
    for n in ("a.pdf", "b.pdf"):
        (out / "x" / n).write_bytes(PDF + n.encode())
    rows = spark.createDataFrame([("x/a.pdf", "A > B: c", "complete"), ("x/b.pdf", None, "complete"), ("x/c.pdf", "A", "complete"), ("", "A", "complete")], "local_path string, subdomain string, pdf_status string")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(out))
    download.to_classified(rows, stored).write.format("paper_files").mode("append").options(path=str(out), least=100).save()
    found = {os.path.relpath(f"{d}/{f}", out): open(f"{d}/{f}", "rb").read() for d, _, fs in os.walk(out) for f in fs}
    assert found == {"x/a.pdf": PDF + b"a.pdf", "x/b.pdf": PDF + b"b.pdf", "classified/A _ B_ c/a.pdf": PDF + b"a.pdf", "classified/paper/b.pdf": PDF + b"b.pdf"}
