"""What an artifact is, from its bytes or its listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import paths as P

# Kinds of artifact in the order of their ordinals.
KINDS = ("Unknown", "DotNetAssembly", "DotNetSingleFile", "NativeWindows", "WindowsInstaller", "ElectronApp", "AsarArchive", "JavaArchive", "PythonBundle", "SourceTree", "Archive")
KIND_LABELS = (
    "Unknown", ".NET assembly", ".NET single-file program", "Native Windows program", "Windows installer", "Electron application", "asar archive", "Java archive",
    "Python bundle", "Source tree", "Archive",
)
# Entry names of an archive and binaries of a folder that are looked at, and the depth at which an app.asar counts.
MOST_NAMES, MOST_BINARIES, ASAR_DEPTH = 2_000, 60, 3
# The signatures of a .NET single-file program and of a common installer, as hexadecimal.
BUNDLE_MARK = "8B1202B96A612038727B930214D7A03213F5B9E6EFAE3318EE3B2DCE24B36AAE"
INSTALLER_MARK = "EFBEADDE4E756C6C736F6674496E7374"


def little(data: Column, at: Column | int, width: int) -> Column:
    """An unsigned little-endian number at a 0-based offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(_reversed_hex(F.substring(data, start, F.lit(width)), width), 16, 10).cast("long")


def _reversed_hex(part: Column, width: int) -> Column:
    text = F.hex(part)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))])


def _printable(data: Column) -> Column:
    """At least 90 % of the first 64 bytes are text."""
    text = F.hex(F.substring(data, 1, 64))
    pairs = F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))
    good = F.filter(pairs, lambda x: x.rlike("^(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]|[89A-F][0-9A-F])$"))
    return (F.size(pairs) > 0) & (F.size(good) >= 0.9 * F.size(pairs))


def is_asar(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 4)).startswith("04000000") & (F.substring(data, 17, 9).cast("string") == '{"files":')


def pe_offset(data: Column) -> Column:
    return little(data, 0x3C, 4)


def pe_kind(data: Column) -> Column:
    """Managed, single-file, installer or native; Unknown where the header is broken."""
    at = pe_offset(data)
    ok = F.coalesce(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(4))) == "50450000", F.lit(False))
    magic = little(data, (at + 24).cast("int"), 2)
    directory = (at + 24 + F.when(magic == 0x20B, 112).otherwise(96) + 14 * 8).cast("int")
    managed = F.coalesce(little(data, directory, 4) > 0, F.lit(False))
    whole = F.hex(data)
    return F.when(~ok, "Unknown").when(managed, "DotNetAssembly").when(whole.contains(BUNDLE_MARK), "DotNetSingleFile").when(whole.contains(INSTALLER_MARK), "WindowsInstaller").otherwise("NativeWindows")


def pe_flags(data: Column) -> Column:
    """struct(aslr, nx, signed) of a PE file; null for others."""
    at = pe_offset(data)
    flags = little(data, (at + 24 + 70).cast("int"), 2)
    magic = little(data, (at + 24).cast("int"), 2)
    certificates = (at + 24 + F.when(magic == 0x20B, 112).otherwise(96) + 4 * 8).cast("int")
    row = F.struct((flags.bitwiseAND(0x40) != 0).alias("aslr"), (flags.bitwiseAND(0x100) != 0).alias("nx"), (little(data, certificates, 4) > 0).alias("signed"))
    return F.when((F.hex(F.substring(data, 1, 2)) == "4D5A") & flags.isNotNull(), row)


def zip_kind(names: Column) -> Column:
    """From the first entry names, in order of priority."""
    some = F.transform(F.slice(names, 1, MOST_NAMES), lambda n: F.lower(P.slashed(n)))
    has = lambda f: F.exists(some, f)
    return (
        F.when(has(lambda n: n == "meta-inf/manifest.mf"), "JavaArchive")
        .when(has(lambda n: n.endswith("resources/app.asar")), "ElectronApp")
        .when(has(lambda n: (n == "package.json") | n.endswith("/package.json")), "SourceTree")
        .otherwise("Archive")
    )


def file_kind(data: Column, names: Column | None = None) -> Column:
    """A single file by content, never by extension; `names` are a zip's entries."""
    head = F.hex(F.substring(data, 1, 4))
    zipped = zip_kind(names) if names is not None else F.lit("Archive")
    return (
        F.when(head.startswith("504B0304") | head.startswith("504B0506"), zipped)
        .when(head == "7F454C46", "Unknown")
        .when(head.startswith("4D5A"), pe_kind(data))
        .when(is_asar(data), "AsarArchive")
        .when(_printable(data), "SourceTree")
        .otherwise("Unknown")
    )


def folder_kind(listing: DataFrame) -> DataFrame:
    """artifact_id, kind of folders, from path and, for binaries, the optional column binary_kind (of the first sixty)."""
    low = F.lower(P.slashed(F.col("path")))
    name = P.basename(low)
    depth = F.size(F.split(low, "/")) - 1
    python = name.rlike(r"\A(?:python3?\d*\.dll|base_library\.zip|python3?\.zip)\z") | low.rlike(r"(?:\A|/)_internal/")
    rows = listing.select(
        "artifact_id", "file_ord", ((name == "app.asar") & (depth <= ASAR_DEPTH)).alias("asar"), (name == "package.json").alias("node"),
        name.rlike(r"\.(?:sln|csproj)\z").alias("project"), name.rlike(r"\.(?:exe|dll)\z").alias("binary"), python.alias("python"),
        (F.col("binary_kind") if "binary_kind" in listing.columns else F.lit(None).cast("string")).alias("bk"),
    )
    nth = F.sum(F.col("binary").cast("int")).over(Window.partitionBy("artifact_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, 0))
    seen = F.col("binary") & (F.col("nth") <= MOST_BINARIES)
    sums = rows.withColumn("nth", nth).groupBy("artifact_id").agg(
        *[F.bool_or(c).alias(c) for c in ("asar", "node", "project", "python")], F.bool_or(seen).alias("binary"),
        F.bool_or(seen & (F.coalesce("bk", F.lit("")) == "DotNetAssembly")).alias("managed"), F.bool_or(seen & (F.coalesce("bk", F.lit("")) == "DotNetSingleFile")).alias("bundle"),
    )
    kind = (
        F.when(F.col("asar"), "ElectronApp").when(F.col("node") | F.col("project"), "SourceTree")
        .when(F.col("binary"), F.when(F.col("managed"), "DotNetAssembly").when(F.col("bundle"), "DotNetSingleFile").when(F.col("python"), "PythonBundle").otherwise("NativeWindows"))
        .when(F.col("python"), "PythonBundle").otherwise("SourceTree")
    )
    return sums.select("artifact_id", kind.alias("kind"))


#: Which reader takes a kind; kinds are disjoint, the rest goes to the native one.
BACKENDS = {"SourceTree": "source", "Archive": "source", "PythonBundle": "source", "ElectronApp": "electron", "AsarArchive": "electron", "DotNetAssembly": "managed", "DotNetSingleFile": "bundle", "WindowsInstaller": "installer"}


def backend(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in BACKENDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), F.lit("native"))


def native_limits(artifacts: DataFrame) -> DataFrame:
    """Native programs give no files: no coverage and four checks that are not possible."""
    notes = ("the program's own code was not read", "credentials in the code were not looked for", "behaviour was not looked for", "dependencies were not looked for")
    return artifacts.where(backend(F.col("kind")) == "native").select("artifact_id", F.lit(0).alias("coverage_percent"), F.array(*[F.lit(n) for n in notes]).alias("not_possible"))


def python_accounting(listing: DataFrame) -> DataFrame:
    """Compiled Python files (the first 20,000 of an artifact), which count as unreadable."""
    compiled = F.lower("path").endswith(".pyc")
    return listing.where(compiled).groupBy("artifact_id").agg(F.least(F.count("*"), F.lit(20_000)).alias("n_unreadable"))
