"""Source trees to parsed files: discovery, change detection, parsing. Files are read by Spark only."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.lineage import settle
from strandline.sources import parse_braces, parse_python
from strandline.sources.aliases import loose_json
from strandline.sources.rules import EXCLUDED_DIRS, EXTENSIONS

MAX_FILE_BYTES = 1_000_000
SNIFF_BYTES = 8192
#: Changed files that are read by their paths.
FEW_FILES = 10_000
RC_FILE = ".strandline.json"
ANN = "array<struct<name:string,arguments:array<string>,line:int>>"
PARSED = (
    "package string, module_id string, imports array<struct<fqn:string,simple_name:string,module:string,imported_name:string>>, "
    f"types array<struct<id:string,kind:string,name:string,parents:array<string>,interfaces:array<string>,start_line:int,end_line:int,annotations:{ANN}>>, "
    f"methods array<struct<id:string,type_id:string,name:string,is_constructor:boolean,params:array<struct<name:string,type:string>>,variadic:boolean,optional:int,start_line:int,end_line:int,return_type:string,modifiers:array<string>,annotations:{ANN},advice_kind:string,pointcut:string,proxies:array<string>,entry_kind:string>>, "
    f"fields array<struct<id:string,type_id:string,name:string,type:string,start_line:int,modifiers:array<string>,annotations:{ANN}>>, "
    "calls array<struct<line:int,receiver:string,receiver_type:string,name:string,arguments:array<string>,type_id:string,method_id:string,is_constructor:boolean,control_flow:array<string>,guards:array<string>>>, "
    "routes array<struct<framework:string,http_method:string,path:string,handler:string,line:int>>, "
    "injections array<struct<owner_id:string,name:string,type:string,framework:string,line:int>>, "
    "reflections array<struct<owner_id:string,target_kind:string,target:string,line:int>>"
)
MANIFEST = "path string, size long, mtime_ms long, sha256 string, language string, parsed string, error string"


@dataclass(frozen=True)
class CrawlOptions:
    language: str | None = None
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    exclude_dirs: Sequence[str] = EXCLUDED_DIRS
    ignore_lines: Sequence[str] = ()
    max_file_bytes: int = MAX_FILE_BYTES
    force: bool = False
    module_roots: Sequence[str] = ("src/main/java/", "src/test/java/")
    aliases: dict = field(default_factory=dict)

    def signature(self) -> str:
        """What a parse depends on besides the file; a change makes every file parse anew."""
        return hashlib.sha256(json.dumps([list(self.module_roots), self.aliases], sort_keys=True).encode()).hexdigest()


def ignore_pattern(glob: str) -> str:
    """A gitignore line as a regular expression over paths relative to the root."""
    line = glob.strip()
    anchored = "/" in line.rstrip("/")
    body = line.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if line.endswith("/") else "(?:/|$)")


def ignored(path: Column, lines: Sequence[str]) -> Column:
    """Whether the last matching line ignores the path; a line with ! takes back."""
    out = F.lit(False)
    for line in lines:
        if line.strip() and not line.startswith("#"):
            back = line.startswith("!")
            out = F.when(path.rlike(ignore_pattern(line[back:])), F.lit(not back)).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)))


def module_of(path: Column, options: CrawlOptions) -> Column:
    """Path to dotted id; package and index files stand for their folder."""
    p = path
    for root in options.module_roots:
        p = F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p)
    p = F.regexp_replace(F.regexp_replace(p, r"\.[A-Za-z]+$", ""), "/", ".")
    return F.regexp_replace(p, r"\.(__init__|index|mod)$", "")


def discover(spark: SparkSession, root: str, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """(uri, path, size, mtime_ms, language) of source files below root; metadata only, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    out = files.select(F.col("path").alias("uri"), path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    out = out.withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL")
    out = out.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in options.exclude_dirs]))) if options.exclude_dirs else out
    out = out.filter(~ignored(F.col("path"), [*options.ignore_lines, *options.exclude]))
    if options.include:
        out = out.filter(ignored(F.col("path"), options.include))
    if options.language:
        out = out.filter((F.col("language") == options.language) | ((F.lit(options.language) == "typescript") & (F.col("language") == "javascript")))
    return out


Parser = Callable[[str, str, str, dict[str, str] | None, bool], dict]
#: Parsers by language: (text, module, language, aliases, whether the file stands for its package) to the parse.
PARSERS: dict[str, Parser] = {
    "python": lambda text, module, language, aliases, package: parse_python.parse(text, module, package),
    **dict.fromkeys(("java", "typescript", "javascript"), lambda text, module, language, aliases, package: parse_braces.parse(text, module, language, aliases)),
}


def register_language(language: str, extensions: Sequence[str], parser: Parser) -> None:
    """Make files with these extensions (".kt") a language's, read by its parser."""
    PARSERS[language] = parser
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def parse_text(text: str, module: str, language: str, aliases: dict[str, str] | None = None, package: bool = False, parsers: dict[str, Parser] | None = None) -> tuple[str | None, str | None]:
    """(parsed as JSON, error); a file that cannot be parsed reports why and gives nothing."""
    try:
        return json.dumps((parsers or PARSERS)[language](text, module, language, aliases, package)), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """MANIFEST rows of files (path, size, mtime_ms, language, module, content)."""
    parsers = dict(PARSERS)  # the workers have the built-in ones only
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.int64()), ("sha256", pa.string()), ("language", pa.string()), ("parsed", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parsed, error = (None, "binary") if b"\0" in r["content"][:SNIFF_BYTES] else parse_text(r["content"].decode("utf-8", "replace"), r["module"], r["language"], aliases, r["path"].rpartition("/")[2] == "__init__.py", parsers)
                rows.append({"path": r["path"], "size": r["size"], "mtime_ms": r["mtime_ms"], "sha256": r["sha256"], "language": r["language"], "parsed": parsed, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "size", "mtime_ms", "sha256", "language", "module", "content").mapInArrow(run, MANIFEST)


def contents_of(files: DataFrame, root: str, options: CrawlOptions) -> DataFrame:
    """(uri, content) of files (uri): read by their paths while these are few and plain, else by a scan of the root."""
    uris = [r.uri for r in files.select("uri").limit(FEW_FILES + 1).collect()]
    read = files.sparkSession.read.format("binaryFile")
    if len(uris) <= FEW_FILES and not any(c in u for u in uris for c in "*?[]{}\\,"):
        if not uris:
            return files.select("uri", F.lit(None).cast("binary").alias("content"))
        found = read.load(uris)
    else:
        found = read.option("recursiveFileLookup", True).load(root).filter(F.col("length") <= options.max_file_bytes)
    return found.select(F.col("path").alias("uri"), "content")


def project_options(spark: SparkSession, root: str, options: CrawlOptions) -> CrawlOptions:
    """The options with the root's .gitignore lines, and include and exclude of its .strandline.json, added."""
    jvm, configuration, text = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for name in (".gitignore", RC_FILE):  # Spark lists no hidden files, so the file system itself is asked
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(configuration)
        if fs.exists(path) and fs.getFileStatus(path).getLen() < MAX_FILE_BYTES:
            with contextlib.closing(fs.open(path)) as stream:
                text[name] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    rc = loose_json(text.get(RC_FILE, "{}"))
    some = lambda name: tuple(x for x in rc.get(name) or () if isinstance(x, str))
    lines = tuple(x.rstrip() for x in text.get(".gitignore", "").splitlines())
    return replace(options, ignore_lines=(*lines, *options.ignore_lines), include=(*options.include, *some("include")), exclude=(*options.exclude, *some("exclude")))


def crawl(spark: SparkSession, root: str, manifest: DataFrame | None = None, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """The new manifest with a column status: unchanged, touched (same contents), updated, added, too-large.

    Files of the same size and time keep their parse unread; the rest are read, and those with the same hash keep it as well.
    Files that the manifest has and the disk has not are left out.
    """
    found = discover(spark, root, options)
    small = found.filter(F.col("size") <= options.max_file_bytes)
    large = found.filter(F.col("size") > options.max_file_bytes).select("path", "size", "mtime_ms", F.lit(None).cast("string").alias("sha256"), "language", F.lit(None).cast("string").alias("parsed"), F.lit("too-large").alias("error"), F.lit("too-large").alias("status"))
    old = (manifest if manifest is not None and not options.force else spark.createDataFrame([], MANIFEST)).select("path", F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime"), F.col("sha256").alias("old_sha"), F.col("parsed").alias("old_parsed"), F.col("error").alias("old_error"))
    known = small.join(old, "path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime"))
    names = ["path", "size", "mtime_ms", "sha256", "language", "parsed", "error"]
    kept = known.filter(same).select("path", "size", "mtime_ms", F.col("old_sha").alias("sha256"), "language", F.col("old_parsed").alias("parsed"), F.col("old_error").alias("error"), F.lit("unchanged").alias("status"))
    rest = settle(known.filter(~F.coalesce(same, F.lit(False))))
    rest = rest.join(contents_of(rest, root, options), "uri").withColumn("sha256", F.sha2("content", 256)).withColumn("module", module_of(F.col("path"), options))
    touched = rest.filter(F.col("sha256") == F.col("old_sha")).select("path", "size", "mtime_ms", "sha256", "language", F.col("old_parsed").alias("parsed"), F.col("old_error").alias("error"), F.lit("touched").alias("status"))
    new = rest.filter(F.col("old_sha").isNull() | (F.col("sha256") != F.col("old_sha")))
    status = new.select("path", F.when(F.col("old_sha").isNull(), "added").otherwise("updated").alias("status"))
    parsed = parse_files(new, options.aliases).join(status, "path")
    return kept.union(touched).union(parsed.select(*names, "status")).union(large.select(*names, "status"))


def parsed_files(manifest: DataFrame) -> DataFrame:
    """(file_path, language, and the parse as columns)."""
    p = manifest.filter("parsed IS NOT NULL").select(F.col("path").alias("file_path"), "language", F.from_json("parsed", PARSED).alias("p"))
    return p.select("file_path", "language", "p.*")
