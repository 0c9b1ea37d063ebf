import datetime as dt
import sys
import types

import pytest
from pyspark.sql import functions as F

from plenum import cli
from plenum.operators import store
from plenum.settings import Settings
from plenum.sources import html, pages, providers
from plenum.streaming import ingest


def test_paper_links(spark):
    page = '<nav><a href="/n">n</a></nav><table class="table table-hover"><tr><th>h</th></tr><tr><td><a href="/a.pdf"> Paper &amp; <b>One</b> </a></td><td> 20 January 2026 </td></tr><tr><td>no link</td><td>x</td></tr><tr><td><a href="http://y/b.pdf"></a></td><td>soon</td></tr><tr><td>one cell</td></tr></table>'
    df = spark.createDataFrame([(1, page), (2, "<table><tr></tr><tr><td>a</td><td>b</td></tr></table>"), (3, None)], "page int, html string")
    got = [tuple(r) for r in html.paper_links(df, "page", "html", "http://b").orderBy("row").collect()]
    assert got == [(1, 1, "Paper & One", "http://b/a.pdf", "2026-01-20"), (1, 3, "Session Paper 3", "http://y/b.pdf", None)]


def test_pages_source(spark):
    made = types.ModuleType("made_pages")
    exec("def fetch(offset):\n    return [('house', f't{offset + i}', 'u', None) for i in range(20)] if offset < 40 else []", made.__dict__)
    sys.modules["made_pages"] = made
    rows = list(pages.PagesReader({"module": "made_pages", "function": "fetch"}).read(None))
    assert len(rows) == 40 and len(list(pages.PagesReader({"module": "made_pages", "function": "fetch", "most": "25"}).read(None))) == 25
    tries = []

    def flaky(offset):
        tries.append(offset)
        if len(tries) < 3:
            raise OSError("gone")
        return []

    made.flaky, made.dead = flaky, lambda offset: (_ for _ in ()).throw(OSError("gone"))
    assert list(pages.PagesReader({"module": "made_pages", "function": "flaky", "pause": "0"}).read(None)) == [] and len(tries) == 3
    with pytest.raises(OSError):
        list(pages.PagesReader({"module": "made_pages", "function": "dead", "pause": "0"}).read(None))


def test_pages_through_spark(spark, tmp_path):
    (tmp_path / "listed_pages.py").write_text("def fetch(offset):\n    return [('house', f't{offset + i}', 'u', None) for i in range(20)] if offset < 60 else []\n")
    spark.sparkContext.addPyFile(str(tmp_path / "listed_pages.py"))
    pages.register(spark)
    df = spark.read.format("pages").option("module", "listed_pages").option("function", "fetch").load()
    assert df.schema.fieldNames() == ["chamber", "title", "pdf_url", "session_date"]
    assert df.count() == 60 and df.filter("title = 't59'").count() == 1


def test_embed(spark):
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in providers.embed(df, "t", embedder, 2).collect()}
    assert got == {0: None, 1: [1.0], 2: [2.0], 3: [3.0], 4: [4.0]}
    e = providers.hashed_embedder(8)
    assert e(["a b"]) == e(["b a"]) and len(e([""])[0]) == 8


def test_limits():
    now, slept = [50.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    a = providers.Allowance(rate=0.5, most=3, clock=lambda: now[0], sleep=sleep)
    assert [a.take() for _ in range(5)] == [0.0, 0.0, 0.0, 2.0, 2.0]
    now[0] += 100  # a long pause fills the bucket to its brim, not beyond
    assert [a.take() for _ in range(4)] == [0.0, 0.0, 0.0, 2.0] and slept == [2.0, 2.0, 2.0]
    for calls, period, cores in ((60, 60.0, 8), (3, 10.0, 64), (1, 5.0, 4), (500, 1.0, 16)):
        lanes, rate = providers.lanes_of(calls, period, cores)
        assert 1 <= lanes <= cores and lanes + lanes * rate * period <= max(calls, 2)
    tries, pauses = [], []

    def broken():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok"

    assert providers.retrying(broken, sleep=pauses.append)() == "ok" and pauses == [2.0, 4.0]


def test_dictionary_and_cooccurrence(spark):
    members = spark.createDataFrame([("s", 0, 0, 0, "The Water  Board met the port authority."), ("s", 0, 0, 1, "waterboard"), ("s", 0, 0, 2, None)], "session_id string, agenda_item_index int, chunk_index int, local_index int, full_text string")
    terms = spark.createDataFrame([("w", "organization", "water board"), ("p", "organization", "Port Authority")], "entity_id string, entity_type string, name string")
    found = providers.dictionary_entities(members, terms)
    assert {(r["local_index"], r["entity_id"]) for r in found.collect()} == {(0, "w"), (0, "p")}
    assert [(r["source_id"], r["target_id"]) for r in providers.cooccurrence(found).collect()] == [("p", "w")]


TERMS = [("water_board", "organization", "water board"), ("port_authority", "organization", "port authority"), ("new_tariff", "law", "new tariff")]


def test_ingest_is_idempotent(spark, small, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = spark.read.parquet(f"{small}/sessions.parquet")
    s.write.parquet(src)
    terms = spark.createDataFrame(TERMS, "entity_id string, entity_type string, name string")
    for _ in range(2):
        ingest.ingest_sessions(spark, src, s.schema, out, str(tmp_path / "cp"), terms=terms).awaitTermination()
    n = s.filter("session_id IS NOT NULL").select("session_id").distinct().count()
    names = ["sessions", "agenda_items", "transcript_sentences", "speakers", "entities", "mentions", "relationships"]
    count = lambda: {t: spark.read.schema(store.SCHEMAS[t]).parquet(f"{out}/{t}").count() for t in names}
    before = count()
    assert before["sessions"] == n and before["transcript_sentences"] > 0
    assert ingest.ingest_batch(s, out, terms=terms)["sessions"] == 0 and count() == before
    assert ingest.ingest_batch(s, out, force=True, terms=terms)["sessions"] == n and count() == before


def test_ingest_fills_all_tables(spark, tmp_path):
    import json

    out, at = str(tmp_path / "o"), dt.datetime(2024, 5, 1)
    said = lambda who, *lines: {"speaker_name": who, "sentences": [{"start_time": f"{i}m", "text": t} for i, t in enumerate(lines)]}
    doc = {"session_title": "x", "agenda_items": [{"topic_title": "Water", "speech_blocks": [said("Hon. Ann Lee", "The water board met the port authority.", "Yes."), said("Bo Chan", "A new tariff.")]}]}
    cols = "session_id string, session_date date, title string, sitting_number string, chamber string, raw_transcript_json string, created_at timestamp, video_id string"
    row = ("s_1_2024_05_01", dt.date(2024, 5, 1), "x", "1", "house", json.dumps(doc), at, "vid")
    other = ("s_2_2024_05_02", dt.date(2024, 5, 2), "y", "2", "house", json.dumps({"agenda_items": []}), at, None)
    terms = spark.createDataFrame(TERMS, "entity_id string, entity_type string, name string")
    store.create_tables(spark, out)
    made = ingest.ingest_batch(spark.createDataFrame([row, other], cols), out, terms=terms)
    assert made == {"sessions": 2, "videos": 1, "agenda_items": 1, "transcript_sentences": 3, "speakers_created": 2, "speakers_matched": 0, "entities": 3, "mentions": 3, "relationships": 1}
    read = lambda t: spark.read.schema(store.SCHEMAS[t]).parquet(f"{out}/{t}")
    m = {r["entity_id"]: r for r in read("mentions").collect()}
    assert m["new_tariff"]["speaker_id"].startswith("bo-chan-") and m["new_tariff"]["speech_block_index"] == 1 and m["water_board"]["timestamp_seconds"] == 0 and m["water_board"]["video_id"] == "vid"
    e = read("relationships").first()
    assert (e["source_entity_id"], e["target_entity_id"], e["evidence_quote"], e["source"]) == ("port_authority", "water_board", "The water board met the port authority.", "extraction")
    assert {r["confidence"] for r in read("entities").collect()} == {0.5} and read("videos").first()["platform"] == "youtube"
    assert {tuple(r["session_ids"]) for r in read("speakers").collect()} == {("s_1_2024_05_01",)}
    # forced: the session loses what its new transcript lacks, the other session keeps its rows
    doc["agenda_items"][0]["speech_blocks"] = [said("Ann Lee", "Nothing.")]
    again = ingest.ingest_batch(spark.createDataFrame([row[:5] + (json.dumps(doc), at, "vid")], cols), out, force=True, terms=terms)
    assert (again["speakers_matched"], again["speakers_created"], again["mentions"]) == (1, 0, 0)
    assert read("transcript_sentences").count() == 1 and read("mentions").count() == 0 and read("relationships").count() == 0 and read("sessions").count() == 2 and read("entities").count() == 3


def test_usage_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t + dt.timedelta(seconds=20 * i), "a", 1.0) for i in range(6)], "ts timestamp, stage string, v double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, stage string, v double").parquet(str(tmp_path / "e"))
    q = ingest.usage_windows(stream, "ts", "stage", "v").writeStream.format("memory").queryName("usage_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["calls"] for r in spark.table("usage_out").collect()) == [3, 3]


def test_cli(spark, small, tmp_path):
    out = str(tmp_path / "d")
    assert cli.main(["--folder", out, "init"], spark) == 0 and cli.main(["--folder", out, "reset"], spark) == 2
    assert cli.main(["--folder", out, "ingest-papers", f"{small}/order_papers.parquet"], spark) == 0
    assert spark.read.parquet(f"{out}/paper_speakers").count() > 0
    assert Settings.read({"PLENUM_CHUNK_SIZE": "9"}).chunk_size == 9 and Settings.read({}).embedding_dimensions == 768


def test_responses(spark):
    def call(prompts):
        return ['{"ok": 1}' if p == "good" else '{"ok": ' for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, p string")
    assert {r["i"]: r["response"] for r in providers.responses(df, "p", call).collect()} == {1: '{"ok": 1}', 2: None, 3: None}


def test_files(spark, tmp_path):
    import json

    from plenum.sources import files

    (tmp_path / "m.json").write_text(json.dumps([{"youtube_url": "https://youtu.be/abc?t=1", "session_date": "2026-01-06", "sitting_number": "12"}, {"youtube_url": "https://x", "session_id": "s"}]))
    got = {(r["video_id"], r["session_id"], r["error"]) for r in files.video_mapping(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("abc", "s_12_2026_01_06", None), (None, "s", "no video id in the address")}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "2026-01-06_A.pdf").write_bytes(b"x")
    links = spark.createDataFrame([("A", "2026-01-06"), ("B", None)], "title string, session_date string")
    stored = files.stored_papers(spark, str(tmp_path / "pdf"))
    assert [r["name"] for r in files.to_fetch(links, stored).collect()] == ["undated_B.pdf"]
    # downloads: stored, skipped, failed
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "p.pdf").write_bytes(b"y" * 200_000)
    todo = spark.createDataFrame([("p.pdf", f"file://{tmp_path}/web/p.pdf"), ("q.pdf", f"file://{tmp_path}/web/none.pdf"), (None, "file:///x")], "name string, pdf_url string")
    status = lambda: {r["name"]: (r["status"], r["bytes"]) for r in files.download(todo, str(tmp_path / "pdf"), piece=1000).collect()}
    assert status() == {"p.pdf": ("success", 200_000), "q.pdf": ("failed", None)} and status()["p.pdf"][0] == "skipped"
    assert sorted(x.name for x in (tmp_path / "pdf").iterdir() if not x.name.startswith(".")) == ["2026-01-06_A.pdf", "p.pdf"]


def test_prompts(spark):
    import json

    from plenum.functions import prompts

    df = spark.createDataFrame([("T", ["Ann"], None, "a,b", [(0, "1m", 'He said "no"'), (1, None, None)])], "t string, s array<string>, c string, r string, x array<struct<index:int,start_time:string,text:string>>")
    p = df.select(prompts.entity_prompt(*[F.col(c) for c in "tscrx"])).first()[0]
    assert "Item: T\nSpeakers: Ann\nEntities named before: a,b\n#0 at 1m He said \"no\"\n#1 at  " in p and "before: \n" not in p
    keyed = df.select(prompts.keyed_json(F.expr("array(struct('1' AS id, 'x\"y' AS value), struct('2' AS id, CAST(NULL AS string) AS value), struct('1' AS id, 'late' AS value))"))).first()[0]
    assert json.loads(keyed) == {"1": 'x"y', "2": None}
    request = json.loads(df.select(prompts.video_request(prompts.transcript_prompt(F.lit("2024-01-01"), F.lit("house"), F.lit(None), F.col("s")), F.lit("u"), 1, F.lit(3), F.lit(60), "high")).first()[0])
    assert (request["fps"], request["start_second"], request["end_second"], request["quality"]) == (1.0, 3, 60, "high") and "Speakers to expect: Ann" in request["prompt"] and "Sitting" not in request["prompt"]
