"""Resolution of imports to files and of calls to symbols, as joins in order of preference."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dir_of, join_path, npm_package_of
from .joins import first_candidate, nearest_ancestor, only_candidate

# Endings that an import may leave out, in order of preference.
JS_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json")
NODE_BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys test timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
#: The running Python's own modules, without its private ones.
PYTHON_STANDARD = sorted(m for m in sys.stdlib_module_names if not m.startswith("_") or m == "__future__")


def _js_tries(base: Column) -> Column:
    """A path as it is, with each ending, as a directory's index; a .js ending may stand for a TypeScript source."""
    swapped = F.regexp_replace(base, r"\.(m|c)?js(x)?$", ".$1ts$2")
    return F.concat(F.array(base, swapped), F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat(base, e)), F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat(base, F.lit("/index"), e)))


def _python_tries(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".pyi")))


def _python_relative(path: Column, spec: Column) -> Column:
    """The directory path that a relative import of so many dots names."""
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    up = F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")
    return join_path(F.concat_ws("/", dir_of(path), up), rest)


def imports(found: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Adds to_path, kind (INTERNAL, EXTERNAL, BUILTIN, UNRESOLVED) and package to imports.

    found: path, language, specifier. files: path. aliases: directory, prefix, replacement (path mappings of the nearest
    configuration). packages: name, directory (workspaces). Candidates are listed in order of preference and joined to the
    files once; the first that exists wins. Absolute Python modules and Java classes are looked for in every source root,
    and only a single hit counts.
    """
    i = found.select("path", "language", "specifier").distinct()
    script = F.col("language").isin("javascript", "typescript")
    relative = F.col("specifier").rlike(r"^\.{1,2}(?:/|$)")
    tries = F.when(script & relative, _js_tries(join_path(dir_of(F.col("path")), F.col("specifier"))))
    tries = tries.when((F.col("language") == "python") & F.col("specifier").startswith("."), _python_tries(_python_relative(F.col("path"), F.col("specifier"))))
    tries = tries.when(F.col("language") == "python", _python_tries(F.regexp_replace("specifier", r"\.", "/")))
    tries = tries.when(F.col("language").isin("c", "cpp"), F.array(join_path(dir_of(F.col("path")), F.col("specifier")), F.col("specifier"), F.concat(F.lit("include/"), "specifier")))
    c = i.select("path", "language", "specifier", F.posexplode(tries.otherwise(F.array().cast("array<string>"))).alias("priority", "candidate"))
    if aliases is not None:
        nearest = nearest_ancestor(i.where(script & ~relative).select("path").distinct(), aliases.groupBy("directory").agg(F.collect_list(F.struct("prefix", "replacement")).alias("maps")), "maps")
        mapped = i.join(nearest.where("maps is not null"), "path").select("path", "language", "specifier", "nearest", F.posexplode("maps").alias("n", "m")).where(F.col("specifier").startswith(F.col("m.prefix")))
        target = join_path(F.col("nearest"), F.concat(F.col("m.replacement"), F.expr("substring(specifier, length(m.prefix) + 1)")))
        c = c.union(mapped.select("path", "language", "specifier", F.posexplode(_js_tries(target)).alias("k", "candidate"), "n").select("path", "language", "specifier", (100 + 50 * F.col("n") + F.col("k")).alias("priority"), "candidate"))
    if packages is not None:
        owned = i.where(script & ~relative).withColumn("name", npm_package_of(F.col("specifier"))).join(packages, "name")
        inside = F.expr("substring(specifier, length(name) + 2)")
        entry = F.when(inside == "", F.concat(F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat("directory", F.lit("/src/index"), e)), F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda e: F.concat("directory", F.lit("/index"), e)))).otherwise(
            F.concat(_js_tries(join_path(F.col("directory"), inside)), _js_tries(join_path(F.concat("directory", F.lit("/src")), inside)))
        )
        c = c.union(owned.select("path", "language", "specifier", F.posexplode(entry).alias("k", "candidate")).select("path", "language", "specifier", (500 + F.col("k")).alias("priority"), "candidate"))
    first = first_candidate(c.withColumnRenamed("path", "from_path"), files.select(F.col("path").alias("to_path")), ["from_path", "language", "specifier"], "candidate", "priority", "to_path")
    # a module path below any source root, if there is just one
    ends = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), -k, k), "/"))).alias("tail"))
    dotted = F.regexp_replace("specifier", r"\.", "/")
    wanted = i.where(((F.col("language") == "python") & ~F.col("specifier").startswith(".")) | (F.col("language") == "java")).select("path", "specifier", F.explode(F.when(F.col("language") == "java", F.array(F.concat(dotted, F.lit(".java")))).otherwise(_python_tries(dotted))).alias("tail"))
    single = only_candidate(wanted, ends.select("tail", F.col("path").alias("rooted")), ["tail"], "rooted").where("rooted is not null").groupBy("path", "specifier").agg(F.min("rooted").alias("rooted"))
    d = i.join(first.withColumnRenamed("from_path", "path"), ["path", "language", "specifier"], "left").join(single, ["path", "specifier"], "left").withColumn("to_path", F.coalesce("to_path", "rooted")).drop("rooted")
    head = F.substring_index(F.regexp_replace("specifier", "^node:", ""), "/", 1)
    builtin = (script & (head.isin(*NODE_BUILTINS) | F.col("specifier").startswith("node:"))) | ((F.col("language") == "python") & F.substring_index("specifier", ".", 1).isin(*PYTHON_STANDARD)) | ((F.col("language") == "java") & F.col("specifier").rlike(r"^javax?\."))
    local = (script & relative) | ((F.col("language") == "python") & F.col("specifier").startswith(".")) | F.col("language").isin("c", "cpp")
    kind = F.when(F.col("to_path").isNotNull(), "INTERNAL").when(builtin, "BUILTIN").when(local, "UNRESOLVED").otherwise("EXTERNAL")
    package = F.when(kind == "EXTERNAL", F.when(script, npm_package_of(F.col("specifier"))).when(F.col("language") == "python", F.substring_index("specifier", ".", 1)).otherwise(F.col("specifier")))
    return d.withColumn("kind", kind).withColumn("package", package)


def calls(sites: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target_key to call sites; null where no symbol can be told.

    sites: path, name, receiver, line. bindings: path, local, to_path, imported ('*' for a namespace). symbols: key, name,
    path, parent. In order: a name imported from a file; a member of an imported namespace; a function of the same file;
    a method through this, self or cls if the file has just one of that name. Names defined nowhere are left out at once.
    """
    names = symbols.select("name").distinct()
    s = sites.join(names, "name", "left_semi").select("path", "name", "receiver", "line")
    top = symbols.where("parent is null").select("key", F.col("name").alias("s_name"), F.col("path").alias("s_path"))
    by_name = s.where("receiver is null").join(bindings.select("path", F.col("local").alias("name"), "to_path", "imported"), ["path", "name"]).join(top, (F.col("s_path") == F.col("to_path")) & (F.col("s_name") == F.col("imported")))
    by_space = s.where("receiver is not null").join(bindings.where("imported = '*'").select("path", F.col("local").alias("receiver"), "to_path"), ["path", "receiver"]).join(top, (F.col("s_path") == F.col("to_path")) & (F.col("s_name") == F.col("name")))
    by_file = s.where("receiver is null").join(top, (F.col("s_path") == F.col("path")) & (F.col("s_name") == F.col("name")))
    methods = symbols.where("parent is not null").groupBy(F.col("path").alias("s_path"), F.col("name").alias("s_name")).agg(F.count("*").alias("n"), F.first("key").alias("key")).where("n = 1")
    by_self = s.where(F.col("receiver").isin("this", "self", "cls")).join(methods, (F.col("s_path") == F.col("path")) & (F.col("s_name") == F.col("name")))
    found = [d.select("path", "name", "receiver", "line", F.lit(k).alias("order"), "key") for k, d in enumerate((by_name, by_space, by_file, by_self))]
    best = reduce(DataFrame.union, found).groupBy("path", "name", "line").agg(F.min_by("key", F.struct("order", "key")).alias("target_key"))
    return s.join(best, ["path", "name", "line"], "left")
