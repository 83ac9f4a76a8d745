"""Tree ingest, document sinks and the streaming jobs."""

import datetime as dt
import json
import random

from pyspark import TaskContext
from pyspark.sql import functions as F

from bomweave.operators import accounts, ledger, policy, scan
from bomweave.plans import documents
from bomweave.plans.scan_report import scan_report
from bomweave.schemas import FILES, PROOF_DRILLS
from bomweave.sources import files as file_source
from bomweave.sources import ledger as ledger_files
from bomweave.streaming import account_stream, commit_stream, jobs, proof_stream, seen, store

from workload import streams

from test_ledger_and_accounts import ATTEMPT, EVENT, KEYS, PROJECTS, START, fold, made_attempts, made_events, proof_intake, replay, sha


def test_ingest_of_a_tree(spark, tmp_path):
    tree = {
        ".env": "OPENAI_API_KEY=sk-" + "m4" * 13 + "\n", "_b.py": "import torch\n", ".git/requirements.txt": "torch",
        "src/deep/er/app.py": "m = 'gpt-4'\n", "src/.hidden/a.py": "import jax\n", "w/model.PT": "weights", "README.md": "x",
        ".aibom.yml": "blocked_models:\n- gpt-4\n", "bin.py": "import keras\n",
    }
    for path, text in tree.items():
        target = tmp_path / "repo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "repo" / "bad.py").write_bytes(b"import keras\nx = 'gpt-4\xff'\n")
    (tmp_path / "repo" / "link").symlink_to(tmp_path / "repo" / "src")
    trees = spark.createDataFrame([("p", "c", str(tmp_path / "repo"))], "project string, commit_sha string, root string")
    files = file_source.read_trees(trees)
    rows = {r["path"]: r["content"] for r in files.collect()}
    assert set(rows) == {p for p in tree if not p.startswith(".git/") and "/.hidden/" not in p} | {"bad.py", "link"}
    assert rows["w/model.PT"] is None and rows["README.md"] is None and rows[".aibom.yml"] == tree[".aibom.yml"]
    landed = str(tmp_path / "landed")
    file_source.land_files(files, landed)
    stored = file_source.read_files(spark, landed)
    assert "PartitionFilters: [isnotnull(part" in policy.policies(stored)._jdf.queryExecution().executedPlan().toString()
    report = scan_report(stored).materialised()
    assert report.postures().first()["compliance_status"] == "Blocked by Policy"
    assert report.scans.first()["scanned_files"] == 9
    assert {(r["name"], r["location"]) for r in report.dependencies.collect()} == {
        ("Exposed Secret", ".env:1"), ("torch", "_b.py:1"), ("Hardcoded Model", "src/deep/er/app.py:1"), ("model.PT", "w/model.PT"),
        ("keras", "bin.py:1"), ("keras", "bad.py:1"), ("Hardcoded Model", "bad.py:2")}
    target = str(tmp_path / "boms")
    ledger_files.write_documents(documents.bom_json(report), "bom_json", target)
    stored = spark.read.json(target).first()
    assert stored["project"] == "p" and json.loads(stored["bom_json"])["scannedFiles"] == 9
    bom, n = ledger_files.read_boms(spark, target, "bom_json").first()["bom"], report.dependencies.count()
    assert bom["scannedFiles"] == 9 and len(bom["dependencies"]) == n
    wanted = sorted((r["name"], r["version"], r["location"]) for r in report.dependencies.collect())
    for indent in (False, True):  # both sinks, both forms
        target = str(tmp_path / f"boms-{indent}")
        ledger_files.write_documents(documents.bom_json(report, indent=indent), "bom_json", target)
        back = documents.dependencies_of_pages(ledger_files.read_documents(spark, target, "bom_json"))
        assert sorted((r["name"], r["version"], r["location"]) for r in back.collect()) == wanted
        assert len(ledger_files.read_boms(spark, target, "bom_json").first()["bom"]["dependencies"]) == n
    target = str(tmp_path / "cyclonedx")
    ledger_files.write_documents(documents.cyclonedx_json(report, F.lit(START)), "cyclonedx_json", target)
    (page,) = ledger_files.read_documents(spark, target, "cyclonedx_json").collect()
    assert len(json.loads(page["cyclonedx_json"])["components"]) == n


def test_deep_folder_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(6):
        for j in range(6):
            path = f"only/src/pkg{i}/mod{j}/a.py"
            (tmp_path / "repo" / path).parent.mkdir(parents=True)
            (tmp_path / "repo" / path).write_text("import torch")
            want.add(path)
    (tmp_path / "repo" / "only" / ".git").mkdir()
    (tmp_path / "repo" / "only" / ".git" / "x").write_text("")
    level = file_source._level

    def traced(batches):
        for frame in level(batches):
            yield frame.assign(root=frame["root"] + f"#{TaskContext.get().partitionId()}")

    trees = spark.createDataFrame([("p", "c", str(tmp_path / "repo"))], "project string, commit_sha string, root string")
    assert {r["path"] for r in file_source.list_trees(trees).collect()} == want
    folders = [("p", "c", str(tmp_path / "repo"), f"only/src/pkg{i}/mod{j}") for i in range(6) for j in range(6)]
    dealt = spark.createDataFrame(folders, "project string, commit_sha string, root string, path string").repartition(
        file_source._tasks(trees), "root", "path").mapInPandas(traced, file_source.LISTING)
    assert len({r["root"] for r in dealt.collect()}) >= 3


def run(stream, tmp_path, name, mode="append", batches=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
    query = writer.format("memory").queryName(name).start() if batches is None else writer.foreachBatch(batches).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_of_files_equals_batch(spark, tmp_path, corpus):
    tree = {"requirements.txt": "torch==1", "a.py": "x = 'gpt-4'", "go.mod": "require a/ollama v1", "main.tf": "g5.xlarge"}
    landed = str(tmp_path / "landed")
    corpus(tree).write.parquet(landed)
    run(jobs.stream_findings(spark, landed), tmp_path, "found")
    columns = ["path", "detector", "name", "version", "location"]
    got = sorted(map(tuple, spark.table("found").select(*columns).collect()), key=str)
    assert got == sorted(map(tuple, scan.findings(corpus(tree)).select(*columns).collect()), key=str)
    assert len(got) == 4


def chunked(spark, rows, schema, folder, pieces):
    """Land rows as ``pieces`` files, read one per micro-batch in order."""
    size = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_intake_never_forgets(spark, tmp_path):
    rows = [(f"e{i}", accounts.CHECKOUT, i, f"c{i}", 0, START + dt.timedelta(minutes=i), None) for i in range(20)]
    replays = [r[:5] + (r[5] + dt.timedelta(days=20),) + r[6:] for r in rows[:8]]
    late = [("late", accounts.CHECKOUT, 99, "c99", 0, START - dt.timedelta(days=18), None)]
    stream = chunked(spark, rows + replays + late + rows[:1], EVENT, str(tmp_path / "events"), 3)
    ids, admitted = seen.SeenIds(spark, str(tmp_path / "seen"), buckets=4), []

    def batch(events, n):
        for _ in range(1 + n % 2):  # one batch runs twice
            found = sorted(r["event_id"] for r in ids.first_deliveries(events, n).collect())
        admitted.extend(found)

    run(stream, tmp_path, "admitted", batches=batch)
    assert sorted(admitted) == sorted([r[0] for r in rows] + ["late"])


def test_seen_filters_grow_and_skip_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FIRST_BITS", 64)
    ids = seen.SeenIds(spark, str(tmp_path / "seen"), buckets=3)
    events = spark.range(400).select(F.col("id").cast("string").alias("event_id"), F.lit(START).alias("received_at"))
    for n in range(4):
        assert ids.first_deliveries(events.filter(F.col("event_id").cast("long") % 4 <= n), n).count() == 100
    filters = ids.store.read("filters").collect()
    assert sum(r["n"] for r in filters) == 400 and all(len(r["bits"]) * 8 >= r["n"] * seen.BITS_PER_ID for r in filters)
    assert ids.first_deliveries(events, 4).count() == 0
    assert ids._suspects(spark.range(1000, 3000).select(F.col("id").cast("string").alias("id")).withColumn(
        "bucket", store.bucket_of("id", buckets=3)), ids.store.read("filters")).count() < 40


def test_uncommitted_batch_is_not_seen(spark, tmp_path):
    tables = store.BatchStore(spark, str(tmp_path / "t"), {"k": "v int"}, {"g": "v int"}, 2)
    rows = spark.createDataFrame([(1, 0), (2, 1)], "v int, bucket int")
    tables.stage("k", rows, 0), tables.stage("g", rows, 0)
    assert tables.last() is None and tables.read("k").count() == tables.read("g").count() == 0
    tables.commit(0, {"k": [0, 1]})
    for version in (1, 2, 3):  # bucket 1 is left alone, bucket 0 is emptied at last
        tables.stage("k", rows.filter("bucket = 0 and v < 2").limit(0 if version == 3 else 1), version)
        tables.stage("g", rows, version)
        assert tables.read("g").count() == 2 * version
        tables.commit(version, {"k": [0]})
    assert [r["v"] for r in tables.read("k").collect()] == [2] and tables.read("g").count() == 8
    assert tables.read("k", before=3).count() == 2 and tables._numbers(f"{tables.target}/commits", "batch") == [2, 3]


def test_stream_admissions_equal_replay(spark, tmp_path):
    rows = sorted(made_attempts(9, rows=120), key=lambda r: (r[3], r[0]))
    stream = chunked(spark, rows, ATTEMPT, str(tmp_path / "attempts"), 3)
    run(jobs.stream_admissions(stream, 7, 3), tmp_path, "admissions")
    got = {r["attempt_id"]: r["accepted"] for r in spark.table("admissions").collect()}
    assert got == replay(rows, 7, 3)


def test_stream_of_accounts_equals_fold(spark, tmp_path):
    rows = sorted(made_events(4, 100), key=lambda r: (r[5], r[0]))
    stream = chunked(spark, rows + rows[:30], EVENT, str(tmp_path / "events"), 3)
    jobs_ = account_stream.AccountStream(spark, str(tmp_path / "accounts"), buckets=3)

    def batch(events, n):
        for _ in range(1 + n % 2):  # one batch runs twice
            jobs_.write(events, n)

    run(stream, tmp_path, "accounts", batches=batch)
    want, outcomes = fold(rows)
    got = {r["user_id"]: {"hash": r["token_hash"], "tier": r["subscription_tier"], "cust": r["stripe_customer_id"]}
           for r in jobs_.state().collect()}
    assert got == want
    answers = jobs_.outcomes().collect()
    assert {r["event_id"]: r["outcome"] for r in answers} == outcomes and len(answers) == len(outcomes)


def test_stream_of_commits_equals_batch(spark, tmp_path, corpus):
    trees = {
        "split": {"requirements.txt": "torch==1", "a.py": "x = 'gpt-4'", "go.mod": "require a/ollama v1", "main.tf": "g5.xlarge",
                  ".aibom.yml": "blocked_models:\n- gpt-4\n", ".git/x.py": "import jax"},
        "clean": {"README.md": "x", "b.txt": "y"}, "open": {"a.py": "import torch", "b.py": "import jax"},
        "later": {"z/requirements.txt": "openai==1", "z/b.py": ""},
    }
    files = {p: [(p, "c1", path, text, len(t)) for path, text in t.items()] for p, t in trees.items()}
    batches = [files["split"][:2] + files["clean"] + files["open"][:1] + files["split"][:1],
               files["split"][1:] + files["later"][:1], files["later"][1:] + files["clean"] + files["split"]]
    commits = commit_stream.CommitStream(spark, str(tmp_path / "commits"), buckets=2)
    seen_by = []
    for n, rows in enumerate(batches):
        for _ in range(1 + n % 2):  # one batch runs twice
            commits.write(spark.createDataFrame(rows, commit_stream.LANDED), n)
        seen_by.append({r["project"] for r in commits.postures().collect()})
    assert seen_by == [{"clean"}, {"clean", "split"}, {"clean", "split", "later"}]
    report = scan_report(corpus({p: t for p, t in trees.items() if p != "open"}, commit="c1").withColumn("commit_sha", F.lit("c1"))).materialised()
    assert sorted(map(tuple, commits.postures().collect())) == sorted(
        map(tuple, report.postures().select("project", "commit_sha", "scanned_files", "compliance_status").collect()))
    assert sorted(map(tuple, commits.boms().collect())) == sorted(
        map(tuple, documents.bom_json(report).select("project", "commit_sha", "page", "bom_json").collect()))
    assert [(r["project"], r["landed"], r["expected"]) for r in commits.open_commits().collect()] == [("open", 1, 2)]


def test_pieces_land_by_all_tasks_and_come_whole(spark):
    rows = spark.range(400).select(F.col("id"), F.col("id").cast("string").alias("path")).repartition(4, "id")
    taken = []

    def write(batch, n):
        files = batch.select("id", F.input_file_name().alias("file")).collect()
        taken.append((n, sorted(r["id"] for r in files), {r["file"] for r in files}))

    streams.streamed(spark, rows, "pieces", F.col("id") % streams.PIECES, write)
    assert [n for n, _, _ in taken] == list(range(streams.PIECES))
    for n, ids, files in taken:
        assert ids == list(range(n, 400, streams.PIECES)) and len(files) == 4


def test_stream_of_proofs(spark, tmp_path):
    keys = spark.createDataFrame([(1, sha("k1"), None, None, None), (2, sha("k2"), "pro", None, 0)], KEYS)
    body = '{"projectName":"%s","commitSha":"%s","scannedFiles":1,"dependencies":[],"finOps":[],"complianceStatus":"Passed"}'
    uploads = [(i, "k1", body % (f"proj{i % 3}", f"s{i}"), START + dt.timedelta(hours=i)) for i in range(14)]
    uploads += [(100 + i, "k2", body % ("other", f"p{i}"), START + dt.timedelta(hours=i)) for i in range(13)] + [
        (200, "bad", body % ("x", "y"), START), (201, "k1", body % ("proj9", "z"), START + dt.timedelta(days=30, minutes=30))]
    uploads.sort(key=lambda r: (r[3], r[0]))
    schema = "upload_id bigint, api_key string, body string, created_at timestamp"
    proofs = proof_stream.ProofStream(spark, str(tmp_path / "proofs"), lambda: keys, buckets=3)

    def batch(rows, n):
        for _ in range(1 + n % 2):  # one batch runs twice
            proofs.write(rows, n)

    run(chunked(spark, uploads, schema, str(tmp_path / "uploads"), 2), tmp_path, "proofs", batches=batch)
    whole = proof_intake(spark.createDataFrame(uploads, schema), keys, spark.createDataFrame([], PROJECTS))
    drop = ("created_at",)
    for got, want in ((proofs.ledger(), whole.drills), (proofs.refused(), whole.refused)):
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))
    assert proofs.ledger().count() == 24 and proofs.refused().count() == 4
    assert sorted(map(str, proofs.projects().drop(*drop).collect())) == sorted(map(str, whole.projects.drop(*drop).collect()))


def test_ledger_files_follow_size_and_hash(spark, tmp_path):
    rows = [(str(i), "p", "u", f"c{i}", "{}", None, "# " + "x" * 2000, sha(str(i)), START + dt.timedelta(days=i % 10 // 9))
            for i in range(400)]
    target = str(tmp_path / "ledger")
    ledger_files.append_drills(spark.createDataFrame(rows, PROOF_DRILLS), target, file_bytes=1 << 17)
    stored = ledger_files.read_drills(spark, target)
    assert sorted(r["id"] for r in stored.collect()) == sorted(r[0] for r in rows)
    files = stored.groupBy("created_date", F.input_file_name().alias("f")).agg(
        F.count("*").alias("n"), F.min("crypto_hash").alias("lo"), F.max("crypto_hash").alias("hi")).collect()
    first = sorted((r["lo"], r["hi"]) for r in files if r["created_date"] == START.date())
    assert len(first) >= 3 and len([r for r in files if r["created_date"] != START.date()]) == 1
    found = ledger.proof(stored, sha("7"), "u")
    assert [r["annex_iv_markdown"][:2] for r in found.collect()] == ["# "]
    assert "EqualTo(crypto_hash" in found._jdf.queryExecution().executedPlan().toString()
    for path in {r["f"] for r in files}:  # row groups are in order of the hash
        hashes = [r["crypto_hash"] for r in spark.read.parquet(path).collect()]
        assert hashes == sorted(hashes)


def test_policy_needs_the_root_file(corpus):
    assert policy.policies(corpus({"a/.aibom.yml": "block_on_high_risk: true"})).count() == 0
