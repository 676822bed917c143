"""Input tables.  The common shape is ``source_files(file_id, shard, path, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_FILES = "file_id bigint, shard string, path string, content string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a table with fewer partitions than cores one partition per core, for work that is heavy per row (lexing
    a text costs far more than moving it).  A table with enough partitions, as any large one has, is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_source_rows(rows: DataFrame) -> DataFrame:
    """(file_id, path, content) of a wide source table with id, repository path and content; other columns are
    never read.  Ids may be any strings; ``sharding`` numbers rows by a key of any type."""
    return rows.select(F.col("id").cast("string").alias("file_id"), F.col("max_stars_repo_path").alias("path"), "content")


def from_documents(documents: DataFrame) -> DataFrame:
    """Text documents as source files.  The paths vary so that every naming rule is met: without a folder, with a
    name that is no word, hash-like, and with another suffix."""
    doc = F.col("doc_id").cast("string")
    folder = F.concat(F.lit("repo/"), F.col("source"), F.lit("/"))
    path = (F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Doc"), doc, F.lit(".java")))
            .when(F.col("doc_id") % 7 == 1, F.concat(folder, F.lit("Doc-"), doc, F.lit(".java")))
            .when(F.col("doc_id") % 7 == 2, F.concat(folder, F.md5("text"), F.lit(".java")))
            .when(F.col("doc_id") % 7 == 3, F.concat(folder, F.lit("Doc"), doc, F.lit(".txt")))
            .otherwise(F.concat(folder, F.lit("Doc"), doc, F.lit(".java"))))
    return documents.select(F.col("doc_id").alias("file_id"), F.col("source").alias("shard"), path.alias("path"),
                            F.col("text").alias("content"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as source files: markup and inline scripts are full of quotes, brackets and slashes."""
    number = F.col("page_id")
    return pages.select(number.alias("file_id"), F.concat(F.lit("site"), (number % 10).cast("string")).alias("shard"),
                        F.col("url").alias("path"), F.col("html").alias("content"))


# A Java file made from a document, as pieces: literal text or (column name,).
_DECLARATIONS = {
    4: "public interface Doc", 5: "enum Doc", 6: "public record Doc", 7: "public @interface Doc",
    9: "non-sealed abstract class Doc",
}
_JAVA_PIECES = [
    "// copied from ", ("source",), "\r\n(header ", ("lang",), ")\r\n\r\npackage repo.", ("source",),
    ";\r\nimport java.util.*;\n/** ", ("text",), " */\n@Entity(name = \"Doc", ("doc_id",),
    "\", tags = {@Tag(\"a)\"), @Tag(value = (1 + 2) * 3)})\n@repo.model.Marked ", ("declaration",), ("doc_id",),
    "(int size) extends Base<List<String>> {\n  // ", ("flat",),
    "\n  @Override @Size(min = 2, max = 20) public String text() { return \"", ("quoted",),
    "\"; } // it's \"done\"\n\tprivate long n = ", ("doc_id",), "L, h = 0x", ("doc_id",), "F, o = 0", ("octal_id",),
    ", b = 0b1", ("binary_id",), "L; double d = ", ("doc_id",), ".5e3f, x = 0x1.", ("doc_id",),
    "p-3; String block = \"\"\"\n    A \"block\" of ", ("source",), "\n    // no comment\n    \"\"\"; char c = '\\''; ",
    "Class<?> k = Doc.class;\n\n  void run(final @NonNull Object o) { for (int i = 0; i < ",
    ("n_chars",), "; i++) { n >>>= i; call(e -> { run(e); }, new int[] {1, 2}); } }\n", ("tail",),
]


def java_pieces() -> list:
    return _JAVA_PIECES


def declaration_cases() -> dict[int, str]:
    return _DECLARATIONS


def java_files(documents: DataFrame) -> DataFrame:
    """One Java file per document, holding its whole text as comment and as string literal.

    By number: interfaces, enums, records, annotation types, files whose braces do not close, classes.
    """
    kind = F.col("doc_id") % 10
    declaration = F.lit("public class Doc")
    for value, text in _DECLARATIONS.items():
        declaration = F.when(kind == value, text).otherwise(declaration)
    flat = F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    made = documents.withColumns({
        "declaration": declaration, "flat": flat,
        "quoted": F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        "octal_id": F.conv(F.col("doc_id").cast("string"), 10, 8), "binary_id": F.conv(F.col("doc_id").cast("string"), 10, 2),
        "tail": F.when(kind == 8, "").otherwise("}\n"),
    })
    pieces = [F.lit(p) if isinstance(p, str) else F.col(p[0]).cast("string") for p in _JAVA_PIECES]
    return from_documents(made.withColumn("text", F.concat(*pieces)))
