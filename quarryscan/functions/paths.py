"""Column functions over relative paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
EXTENSIONS = {
    "CSharp": "cs",
    "JavaScript": "js jsx mjs cjs",
    "TypeScript": "ts tsx mts cts",
    "Python": "py pyw",
    "Java": "java kt",
    "Json": "json",
    "Config": "yml yaml toml ini config xml",
    "Markup": "html htm vue svelte xaml",
    "Shell": "sh bash ps1 bat cmd",
    "Other": "go rs rb php swift dart scala ex exs lua pl r jl zig groovy m mm c h cpp cc hpp cxx sql graphql gql proto razor cshtml astro erb ejs hbs twig vb fs fsx clj cljs elm hs",
}
# Folders of which only manifests are read.
VENDORED = (".git", ".svn", ".hg", "node_modules", ".venv", "venv", "__pycache__", ".gradle", ".idea", ".vs", "obj")
# File names of dependency manifests (a name that ends in .deps.json is one too).
MANIFESTS = (
    "packages.lock.json", "package-lock.json", "package.json", "requirements.txt", "pipfile.lock", "yarn.lock", "pnpm-lock.yaml",
    "go.sum", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "gradle.lockfile",
)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension without its point, or the empty text."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)\z", 1))


def language_of(path: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(e), F.lit(lang)) for lang, es in EXTENSIONS.items() for e in es.split()))
    return F.when(F.lower(basename(path)).startswith(".env"), F.lit("Config")).otherwise(F.coalesce(F.try_element_at(names, extension(path)), F.lit("Unknown")))


def is_test_or_example(path: Column) -> Column:
    """The parts and ends of paths that mark tests and examples."""
    low = F.lower(path)
    inside = low.contains("/test") | low.contains("/spec") | low.contains("/__mocks__") | low.contains("/example") | low.contains("/fixture")
    return inside | low.endswith(".test.js") | low.endswith(".spec.ts") | low.endswith(".example") | low.endswith(".sample")


def is_generated(path: Column) -> Column:
    """The ends and folders of files that programs write."""
    low = F.lower(path)
    return low.endswith(".min.js") | low.endswith(".bundle.js") | low.endswith(".g.cs") | low.endswith(".designer.cs") | low.contains("/vendor/")


def is_build_scratch(path: Column) -> Column:
    """An obj folder anywhere, or bin/Debug."""
    return F.lower(slashed(path)).rlike(r"(?:\A|/)(?:obj(?:/|\z)|bin/debug(?:/|\z))")


def is_manifest(path: Column) -> Column:
    low = F.lower(basename(path))
    return low.isin(*MANIFESTS) | low.endswith(".deps.json")


def is_candidate(path: Column) -> Column:
    """Files worth reading: manifests everywhere; outside vendored folders also .env files and known languages."""
    folders = F.transform(F.split(F.lower(slashed(path)), "/"), lambda x: x)
    vendored = F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.isin(*VENDORED))
    return is_manifest(path) | (~vendored & (F.lower(basename(path)).startswith(".env") | (language_of(path) != "Unknown")))


def is_unsafe(path: Column) -> Column:
    """Absolute, with a drive, or with a parent step."""
    plain = slashed(path)
    return plain.rlike(r"\A/|\A[A-Za-z]:|(?:\A|/)\.\.(?:/|\z)|\x00") | (plain == "")


def is_endpoint_allowed(url: Column) -> Column:
    """https, or http on the machine itself."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    protocol = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    return ((protocol == "https") & (host != "")) | ((protocol == "http") & host.isin("localhost", "127.0.0.1", "[::1]"))


def normalise_endpoint(url: Column) -> Column:
    """Trimmed, without trailing slashes; null where it may not be called."""
    plain = F.regexp_replace(F.trim(url), r"/+\z", "")
    return F.when(is_endpoint_allowed(plain), plain)
