"""Software inventory: manifests to components, package URLs, bills of materials, known vulnerabilities, drafts of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Manifest name -> package URL type and ecosystem.
ECOSYSTEMS = {"requirements.txt": ("pypi", "PyPI"), "requirements-dev.txt": ("pypi", "PyPI"), "prod.txt": ("pypi", "PyPI"), "pyproject.toml": ("pypi", "PyPI"), "package.json": ("npm", "npm"), "go.mod": ("golang", "Go"), "Cargo.toml": ("cargo", "crates.io")}
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
UNKNOWN = "UNKNOWN"
_ITEM = r"^([A-Za-z0-9_.\-]+)(?:\s*[=<>!~]=?\s*([A-Za-z0-9_.+\-]+))?"
#: Rule prefix -> title, guidance, a line before and the line after. The longest prefix of a rule id counts.
FIXES = {
    "SEC-001": ("Take the access key out of the code", "Revoke it, issue a new one, and read that from the environment.", "KEY = 'AKIA..'", "KEY = os.environ['KEY_ID']"),
    "SEC-001b": ("Take the secret key out of the code", "Revoke it and let the platform hand the new one to the process.", "secret_key = '..'", "secret_key = os.environ['SECRET_KEY']"),
    "SEC-002": ("Read this credential at run time", "Keep a name in the code and the value in the environment or a vault.", "password = '..'", "password = os.environ['PASSWORD']"),
    "SEC-002b": ("Withdraw this provider token", "Tokens in a repository count as published: withdraw it and store its successor elsewhere.", "token = 'ghp_..'", "token = os.environ['TOKEN']"),
    "SEC-003": ("Do without evaluated text", "Parse literals, or look the wanted function up in a table.", "x = eval(text)", "x = ast.literal_eval(text)"),
    "SEC-004": ("Hand values to execute() apart from the query", "The driver quotes values that are passed as parameters.", "cur.execute(f'.. {a}')", "cur.execute('.. ?', (a,))"),
    "SEC-005": ("Start the program without a shell", "A list of arguments is not parsed by a shell.", "run(cmd, shell=True)", "run(['ls', path])"),
    "SEC-005b": ("Start the program through subprocess", "os.system parses its text in a shell; a list of arguments is passed as it is.", "os.system('ls ' + p)", "subprocess.run(['ls', p])"),
    "SEC-006": ("Load YAML as plain data", "The safe loader builds no objects.", "yaml.load(f)", "yaml.safe_load(f)"),
    "SEC-009": ("Exchange data in a format without code", "Unpickling can call anything; JSON cannot.", "pickle.loads(b)", "json.loads(b)"),
    "SEC-011": ("Replace the webhook address", "Whoever has the address can post: make a new one and keep it out of the code.", "HOOK = 'https://..'", "HOOK = os.environ['HOOK']"),
    "AST-003": ("Do without evaluated text, under any name", "An alias of eval evaluates as well.", "e = eval; e(t)", "ast.literal_eval(t)"),
    "AST-004": ("Bind the outside value", "The query text stays constant; what comes from outside is a parameter.", "cur.execute(q + a)", "cur.execute(q, (a,))"),
    "AST-004b": ("Keep the query text constant", "Formatting a query mixes code and data.", "cur.execute('%s' % a)", "cur.execute('?', (a,))"),
    "AST-005": ("Pass arguments as a list, no shell", "Nothing is left for a shell to interpret.", "run(c, shell=True)", "run([prog, arg])"),
    "AST-006": ("Name a safe YAML loader", "Without one, tags in the file choose what is built.", "yaml.load(f)", "yaml.load(f, Loader=yaml.SafeLoader)"),
    "AST-009": ("Unpickle nothing from outside", "Use a format that only holds data.", "pickle.load(f)", "json.load(f)"),
    "JS-001": ("Call functions, not text", "Build no code at run time.", "eval(s)", "table[s]()"),
    "JS-002": ("Pass the command's arguments apart", "execFile starts a program without a shell.", "exec(`ls ${d}`)", "execFile('ls', [d])"),
    "JS-004": ("Write text, not markup", "Text content is not parsed.", "e.innerHTML = s", "e.textContent = s"),
    "GO-002": ("Use the driver's placeholders", "Formatted queries are parsed with the value in them.", "db.Query(fmt.Sprintf(..))", "db.Query(q, v)"),
    "JAVA-002": ("Prepare the statement", "Parameters of a prepared statement are data.", "st.execute(q + v)", "ps.setString(1, v)"),
    "C-001": ("Bound every copy", "Give the size of the target.", "strcpy(a, b)", "snprintf(a, sizeof a, \"%s\", b)"),
    "C-002": ("Start programs without a shell", "exec functions take arguments one by one.", "system(c)", "execv(p, args)"),
    "INFRA-001": ("Give the image a user of its own", "A process that is not root can do less harm.", "USER root", "USER app"),
    "INFRA-002": ("Open the port to known networks", "Name the address ranges that need it.", "0.0.0.0/0", "10.0.0.0/8"),
    "INFRA-003": ("Take the container's privileges away", "Add the capabilities that it needs, one by one.", "privileged: true", "privileged: false"),
}


def _item(text: Column) -> Column:
    return F.struct(F.regexp_extract(text, _ITEM, 1).alias("name"), F.regexp_extract(text, _ITEM, 2).alias("version"))


def _requirements(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\s*\r?\n\s*"), lambda x: F.regexp_replace(x, r"^\s+", ""))
    wanted = F.filter(lines, lambda x: x.rlike(r"^[^#\-]"))
    return F.transform(wanted, _item)


def _pyproject(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    return F.transform(F.regexp_extract_all(block, F.lit('"([^"]+)"'), F.lit(1)), _item)


def _package_json(text: Column) -> Column:
    parsed = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    entries = [F.coalesce(F.map_entries(parsed[s]), F.array().cast("array<struct<key:string,value:string>>")) for s in SECTIONS]
    return F.transform(F.concat(*entries), lambda e: F.struct(e["key"].alias("name"), F.regexp_replace(e["value"], r"^[\^~>=<]+", "").alias("version")))


def _go_mod(text: Column) -> Column:
    line = r"(?m)^\s*([A-Za-z0-9.\-_/]+)\s+v([0-9]\S+)"
    return F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, line, 1).alias("name"), F.regexp_extract(m, line, 2).alias("version")))


def _cargo(text: Column) -> Column:
    block = F.concat_ws("\n", F.regexp_extract_all(text, F.lit(r"(?s)(?:^|\n)\[dependencies\][^\n]*\n(.*?)(?=\n\[|$)"), F.lit(1)))
    line = r'(?m)^([A-Za-z0-9_\-]+)\s*=\s*(?:"|\{[^}\n]*version\s*=\s*")([^"\n]+)"'
    return F.transform(F.regexp_extract_all(block, F.lit(line), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, line, 1).alias("name"), F.regexp_extract(m, line, 2).alias("version")))


def components(manifests: DataFrame) -> DataFrame:
    """project, place, name, version, purl, ecosystem of manifests(project, path, content); of equal ones (name in lower case, version, type) the first.

    place orders a project's components: by path, then by place in the file. Unknown manifests and those that do not parse have none.
    """
    known = F.element_at(F.split("path", "/"), -1)
    parsers = {"package.json": _package_json, "go.mod": _go_mod, "Cargo.toml": _cargo, "pyproject.toml": _pyproject}
    items = F.coalesce(*(F.when(known == n, parsers.get(n, _requirements)(F.col("content"))) for n in ECOSYSTEMS))
    kind = F.create_map(*(F.lit(x) for n, (t, _) in ECOSYSTEMS.items() for x in (n, t)))
    system = F.create_map(*(F.lit(x) for n, (_, e) in ECOSYSTEMS.items() for x in (n, e)))
    rows = manifests.select("project", "path", kind[known].alias("type"), system[known].alias("ecosystem"), F.posexplode(items).alias("at", "c")).where("c.name <> ''")
    first = rows.groupBy("project", F.lower("c.name").alias("_key"), F.coalesce("c.version", F.lit("")).alias("_version"), "type").agg(F.min(F.struct("path", "at", F.col("c.name").alias("name"), "ecosystem")).alias("r"))
    purl = F.concat(F.lit("pkg:"), "type", F.lit("/"), "r.name", F.when(F.col("_version") != "", F.concat(F.lit("@"), "_version")).otherwise(""))
    return first.select("project", F.struct("r.path", "r.at").alias("place"), F.col("r.name").alias("name"), F.when(F.col("_version") == "", UNKNOWN).otherwise(F.col("_version")).alias("version"), purl.alias("purl"), F.col("r.ecosystem").alias("ecosystem"))


def cyclonedx(found: DataFrame) -> DataFrame:
    """project, document: a CycloneDX 1.5 document per project. A project's components are those of its manifests, so a document fits a task."""
    part = F.struct(F.lit("library").alias("type"), "name", "version", "purl")
    rows = found.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("c")))), lambda x: x["c"]).alias("components"))
    return rows.select("project", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("document"))


def spdx(found: DataFrame) -> DataFrame:
    """project, document: an SPDX 2.3 document per project; packages are numbered from 1 in the order of their places."""
    rows = found.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("place", "name", "version", "purl"))).alias("cs"))
    name = lambda i: F.concat(F.lit("SPDXRef-Package-"), (i + 1).cast("string"))
    packages = F.transform("cs", lambda c, i: F.struct(name(i).alias("SPDXID"), c["name"].alias("name"), c["version"].alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), c["purl"].alias("referenceLocator"))).alias("externalRefs")))
    links = F.transform("cs", lambda c, i: F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), name(i).alias("relatedSpdxElement")))
    return rows.select("project", F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), packages.alias("packages"), links.alias("relationships"))).alias("document"))


def advisory_severity(score: Column, stated: Column) -> Column:
    """From a number at the end of a CVSS score, else the stated severity, else MEDIUM."""
    number = F.nullif(F.regexp_extract(score, r"(?i)CVSS.*?([0-9]+\.?[0-9]*)\s*$", 1), F.lit("")).cast("double")
    by_number = F.when(number >= 9, "CRITICAL").when(number >= 7, "HIGH").when(number >= 4, "MEDIUM").when(number.isNotNull(), "LOW")
    return F.coalesce(by_number, F.when(F.upper(stated).isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.upper(stated)), F.lit("MEDIUM"))


def vulnerable(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components with advisories(ecosystem, name, version, id, score, stated) as findings. Components of unknown version are not looked up."""
    rows = found.where(F.col("version") != UNKNOWN).join(advisories, ["ecosystem", "name", "version"])
    return rows.select("project", F.concat(F.lit("CVE-"), "id").alias("rule_id"), advisory_severity(F.col("score"), F.col("stated")).alias("severity"), F.concat(F.lit("dependency:"), "ecosystem", F.lit("/"), "name").alias("path"))


def fix_drafts(findings: DataFrame) -> DataFrame:
    """findings with title, guidance, diff and confidence of the fix whose rule prefix is the longest. The fixes are a short fixed list, tried longest first."""
    some = [(F.startswith("rule_id", F.lit(k)), FIXES[k]) for k in sorted(FIXES, key=len, reverse=True)]
    pick = lambda value: F.coalesce(*(F.when(fits, value(*fix)) for fits, fix in some))
    best = pick(lambda title, guidance, before, after: title)
    diff = pick(lambda title, guidance, before, after: f"-{before}\n+{after}")
    guidance = F.coalesce(pick(lambda title, guidance, before, after: guidance), F.lit("Look at the finding and correct its cause."))
    return findings.select("*", F.coalesce(best, F.concat(F.lit("Address "), "rule_id")).alias("title"), guidance.alias("guidance"), diff.alias("diff"), F.when(best.isNotNull(), "high").otherwise("medium").alias("confidence"))


def rollup(found: DataFrame, known: DataFrame) -> DataFrame:
    """project, packages_discovered, packages_with_vulns, total_vulns, critical_vulns: every project of found, the table of components(); known as in vulnerable()."""
    bad = vulnerable(found, known).groupBy("project").agg(F.countDistinct("path").alias("packages_with_vulns"), F.count("*").alias("total_vulns"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_vulns"))
    return found.groupBy("project").agg(F.count("*").alias("packages_discovered")).join(bad, "project", "left").na.fill(0)
