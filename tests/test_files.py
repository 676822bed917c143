import zipfile
import zlib

from pyspark.sql import functions as F

from tokenloom.operators import cleaning, corpus, filters, ranking, sharding, stats, vocabulary
from tokenloom.plans import pipeline
from tokenloom.sources import archives, sinks, tables, textfiles

SOURCE = tables.SOURCE_FILES


def test_archives(spark, tmp_path):
    for name in ("part_0000.zip", "part_0001.ZIP"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("d/A_1.java", "class A {}")
            z.writestr("B_2.java", b"x\xff")
            z.writestr("note.txt", "n")
    (tmp_path / "other.bin").write_bytes(b"x")
    read = archives.read_archives(spark, str(tmp_path), ".java")
    assert sorted((r.shard, r.path) for r in read.collect()) == [
        (s, p) for s in ("part_0000", "part_0001") for p in ("B_2.java", "d/A_1.java")]
    assert {r.content for r in archives.content_of(read).collect()} == {"class A {}", "x\ufffd"}
    assert filters.readable(read).count() == 2
    assert [r.error for r in filters.unreadable(read).collect()] == ["invalid UTF-8"] * 2


def test_archives_that_cannot_be_read(spark, tmp_path):
    """An archive cut short and an entry with damaged bytes are rows with an error; all else is read."""
    for k in range(4):
        with zipfile.ZipFile(tmp_path / f"p{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(5):
                z.writestr(f"{i}.java", f"class C{i} {{ {'x' * 500 * i} }}")
    whole = (tmp_path / "p1.zip").read_bytes()
    (tmp_path / "p1.zip").write_bytes(whole[:-40])
    with zipfile.ZipFile(tmp_path / "p2.zip") as z:
        place = z.getinfo("3.java").header_offset + 40
    damaged = bytearray((tmp_path / "p2.zip").read_bytes())
    damaged[place:place + 6] = b"\xff" * 6
    (tmp_path / "p2.zip").write_bytes(damaged)
    (tmp_path / "empty.zip").write_bytes(b"")
    for read in (archives.scan_archives, archives.spark_archives):
        rows = read(spark, str(tmp_path), ".java").collect()
        good = {(r.shard, r.path) for r in rows if r.error is None}
        assert good == {(f"p{k}", f"{i}.java") for k in (0, 2, 3) for i in range(5)} - {("p2", "3.java")}
        bad = sorted((r.shard, r.path or "", r.error.split(":")[0], r.data) for r in rows if r.error)
        empty = [("empty", "", "archive", None)] if read is archives.scan_archives else []       # Spark's readers skip empty files
        assert bad == [*empty, ("p1", "", "archive", None), ("p2", "3.java", "entry", None)]
    assert archives.read_archives(spark, str(tmp_path)).count() == 14


def test_large_archives_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PARTITION", 100)
    rows = [(f"s{i % 3}", f"d/{i}.{'java' if i % 2 else 'txt'}", bytes([i]) * 90) for i in range(60)]
    made = archives.write_archives(spark.createDataFrame(rows, "shard string, path string, data binary"), f"file:{tmp_path}/z")
    assert {(r.shard, r.entries) for r in made.collect()} == {("s0", 20), ("s1", 20), ("s2", 20)}
    reader = archives._ZipReader({"path": str(tmp_path / "z")})
    parts = reader.partitions()
    assert len(parts) > 3 and all(len(p.ranges) == 1 for p in parts)
    found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["shard"], r["path"], r["data"]) for r in found) == sorted(rows)
    reader = archives._ZipReader({"path": str(tmp_path / "z"), "suffix": ".txt"})
    assert {r["path"][-4:] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()} == {".txt"}
    assert archives.scan_archives(spark, str(tmp_path / "z"), ".java").count() == 30
    (tmp_path / "none").mkdir()
    assert archives.scan_archives(spark, str(tmp_path / "none")).count() == 0


def test_text_files_and_lines(spark, tmp_path):
    for shard, name, text in [("processed_part_0000", "a.txt", " x \n\ny"), ("processed_part_0001", "b.txt", "z"), ("other", "c.txt", "n")]:
        (tmp_path / shard).mkdir(exist_ok=True)
        (tmp_path / shard / name).write_text(text)
    (tmp_path / "processed_part_0000" / "skip.md").write_text("m")
    rows = textfiles.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.shard, r.path, r.content) for r in rows) == [
        ("processed_part_0000", "a.txt", " x \n\ny"), ("processed_part_0001", "b.txt", "z")]
    assert sorted(r.path for r in textfiles.read_bytes(spark, str(tmp_path)).collect()) == ["a.txt", "b.txt"]
    lines = textfiles.read_lines(spark, str(tmp_path / "processed_part_0000" / "a.txt"))
    assert [r.line for r in lines.collect()] == ["x", "", "y"]


def test_maps_and_frequency_files(spark, tmp_path):
    (tmp_path / "map.txt").write_text("0 !LEX_NEWLINE <EOL>\n1    \n7 & a b\n\n9 k\n")
    rows = {r.token_id: r.text for r in textfiles.read_id_map(spark, str(tmp_path / "map.txt")).collect()}
    assert rows == {"0": "<EOL>", "1": "", "7": "a b", "9": ""}
    (tmp_path / "freq.txt").write_text('"a: 3": 12\nname: 4\nbroken\n')
    freq = textfiles.read_frequencies(spark, str(tmp_path / "freq.txt"))
    assert sorted((r.item, r.cnt, r.weight) for r in ranking.weighted(freq).collect()) == [('"a: 3"', 12, 72), ("name", 4, 16)]


def test_outputs(spark, tmp_path):
    files = spark.createDataFrame([(i, "s", f"x/C{i}.java", f"class C{i} {{ String s = \"é{i}\"; }}\n\n") for i in range(7)], SOURCE)
    sinks.write_shards(files, str(tmp_path / "shards"), rows_per_shard=3)
    counts = spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().orderBy("shard").collect()
    assert [(r.shard, r["count"]) for r in counts] == [("part_0000", 3), ("part_0001", 3), ("part_0002", 1)]
    sinks.write_cleaned(files, str(tmp_path / "clean"))
    for r in spark.read.parquet(str(tmp_path / "clean")).collect():
        data = r.content.encode()
        assert (r.size, r.crc32, r.shard) == (len(data), zlib.crc32(data), "processed_s")
    sinks.write_values(files, str(tmp_path / "values"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "values/kind=literals")).collect()) == [f'"é{i}"' for i in range(7)]
    sinks.write_corpus(files, str(tmp_path / "corpus"), single_file=True)
    assert spark.read.text(str(tmp_path / "corpus")).count() == 7
    sinks.write_report(stats.corpus_stats(files), str(tmp_path / "report"))
    assert "string_literals: 7.0" in [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    sinks.write_ordered_lines(vocabulary.vocabulary_lines(vocabulary.base_vocabulary(spark)), str(tmp_path / "vocab"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "vocab")).collect()]
    assert len(lines) == 226 and lines[0] == "0 !LEX_NEWLINE <EOL>" and lines[98] == "98 !LEX_ABSTRACT abstract"
    sinks.write_dataset_size(files, str(tmp_path / "size"))
    assert [r.value for r in spark.read.text(str(tmp_path / "size")).collect()][0] == "Total files: 7"
    encoded = files.select("file_id", "shard", "path", F.lit("\ue000\n").alias("unicode"))
    sinks.write_encoded(encoded, str(tmp_path / "encoded"))
    assert "s/x/C3_unicode.txt" in {r.file_path for r in spark.read.parquet(str(tmp_path / "encoded")).collect()}


def test_cleaning(spark):
    java = """// licence
package a;
/** doc */ @A(x = {@B("(")}, y = (1)) @c.D
public @interface Q { int v() default 1; }
class C { @Override public void f(@N Object o) { for (;;) { g(); /* c */ } } String s = "//no"; }
"""
    out = cleaning.clean(spark.createDataFrame([(1, "s", "p", java), (2, "s", "p", "nothing")], SOURCE)).collect()
    assert [(r.file_id, r.content) for r in out] == [(1, "\n".join([
        "package a ;", "public @ interface Q {", "int v ( ) default 1 ;", "}", "class C {",
        "public void f ( Object o ) {", "for ( ; ; ) {", "g ( ) ;", "}", "}", 'String s = "//no" ;', "}"]))]


def test_cleaning_long_texts_and_rows_in_place(spark):
    unit = "@A(x = {@B(1)}) void f(@c.D int a) { for (;;) { g(a.b(c)); } }\n"
    files = spark.createDataFrame([(1, "s", "p", "class C {" + unit * 700 + "}"), (2, "s", "p", "@A"), (3, "s", "p", None)], SOURCE)
    cleaned = cleaning.clean(files)
    rows = cleaned.collect()
    one = "void f ( int a ) {\nfor ( ; ; ) {\ng ( a . b ( c ) ) ;\n}\n}\n"
    assert [(r.file_id, r.content) for r in rows] == [(1, "class C {\n" + one * 700 + "}")]
    assert "Exchange" not in cleaned._jdf.queryExecution().toString()


def test_garbage(spark):
    rows = [(1, "d/A.java", "class A {}"), (2, "d/" + "0" * 32 + ".java", "class A {}"), (3, "d/R.java", "package a; record R() {}"),
            (4, "d/E.java", ""), (5, "d/U.java", "class U {"), (6, "d/N.java", "import x;\nFoo.class")]
    files = spark.createDataFrame([(i, "s", p, c) for i, p, c in rows], SOURCE)
    ids = lambda df: sorted(r.file_id for r in df.collect())
    assert ids(filters.drop_garbage(files)) == [1, 5]
    assert ids(filters.keep_usable(files)) == [1]
    assert ids(filters.drop_empty(files)) == [1, 2, 3, 5, 6]


def test_usable_files_are_cut_into_tokens_once(spark, tmp_path):
    unit = "@A(x = 1) void f(int a) { g(a); } // no\r\n"
    texts = ["head\r\npackage a;\r\nclass C {" + unit * n + "}\n\n" for n in range(4)]
    texts += ["class U {", "@A", None, "", "enum E {}", "x", "@interface I {}"]
    spark.createDataFrame([(i, "s", f"d/A{i}.java", t) for i, t in enumerate(texts)], SOURCE).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    cleaned = pipeline.cleaned_files(files)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("non-sealed|[") == 1
    apart = files.transform(filters.keep_usable).transform(cleaning.clean).select("file_id", "shard", "path", "content")
    assert sorted(cleaned.collect()) == sorted(apart.collect()) and cleaned.count() == 5


def test_row_numbers_do_not_depend_on_ranges(spark):
    keys = [(k * k * 37 % 100_003,) for k in range(1, 3000)]
    df = spark.createDataFrame(keys, "file_id bigint").distinct()
    order = {k: i for i, k in enumerate(sorted(r.file_id for r in df.collect()))}
    for ranges in (1, 3, 16):
        assert {r.file_id: r.row_index for r in sharding.with_row_index(df, ranges=ranges).collect()} == order


def test_split_covers_everything(spark):
    files = spark.createDataFrame([(i, f"s{i % 11:02}", "p.txt", "c") for i in range(110)], SOURCE)
    for ratio in (0.0, 0.05, 0.5, 0.9, 1.0):
        train = {r.file_id for r in sharding.training_files(files, ratio).collect()}
        rest = {r.file_id for r in sharding.evaluation_files(files, ratio).collect()}
        assert not train & rest and len(train | rest) == 110 and len(train) == int(11 * ratio) * 10
    assert sharding.sample_shards(files, 5).count() == 10


def test_statistics_count_each_blank(spark):
    row = stats.with_averages(stats.corpus_stats(spark.createDataFrame(
        [(1, "s", "p", 'int  ab = "x\U0001F600";\r\n\tnull')], SOURCE))).first()
    assert (row.eol, row.whitespace_no_eol, row.keyword, row.literal, row.total_tokens) == (1, 5, 1, 2, 12)
    assert (row.string_literals, row.literal_chars, row.literal_bytes, row.avg_literal_chars, row.avg_identifier_chars) == (1, 5, 7, 5.0, 2.0)


def test_frequencies(spark):
    files = spark.createDataFrame([(1, "s", "p", 'a b a "x: 1" "x: 1" c a')], SOURCE)
    rows = ranking.ranked(ranking.frequencies(ranking.values(files))).collect()
    assert [(r.kind, r.item, r.cnt) for r in rows] == [("identifiers", "a", 3), ("identifiers", "c", 1), ("identifiers", "b", 1), ("literals", '"x: 1"', 2)]


def test_corpus(spark):
    files = spark.createDataFrame([(1, "s", "p", " a \n\nb"), (2, "s", "p", " \n")], SOURCE)
    assert [(r.file_id, r.content) for r in corpus.joined(files).collect()] == [(1, "a\nb\n")]
