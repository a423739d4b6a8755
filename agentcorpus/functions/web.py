"""Host names, registrable domains, website surfaces and website categories."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentcorpus.functions.staging import bound
from agentcorpus.functions.text import blank_to, strip

# ---- fixed values: vocabularies, category names and product aliases -------------------------
APPLICATION_CATEGORIES = ("work_application", "transactional_application", "service_application")
WORK_WORDS = (
    "airtable", "asana", "atlassian", "calendar", "canva", "clickup", "confluence", "docs",
    "drive", "dropbox", "figma", "github", "gitlab", "gmail", "hubspot", "jira", "linear", "mail",
    "monday", "notion", "office", "outlook", "salesforce", "sheets", "slack", "slides", "teams",
    "trello", "zoom",
)
TRANSACTION_WORDS = (
    "airbnb", "amazon", "booking", "doordash", "ebay", "expedia", "flight", "hotel", "instacart",
    "shop", "store", "travel", "walmart",
)
SERVICE_WORDS = (
    "bank", "clinic", "college", "coursera", "edu", "finance", "gov", "health", "insurance",
    "school", "university",
)
CONTENT_WORDS = (
    "blog", "cnn", "encyclopedia", "forbes", "magazine", "news", "nytimes", "wikipedia",
)
VOCABULARIES = (
    ("work_application", WORK_WORDS),
    ("transactional_application", TRANSACTION_WORDS),
    ("service_application", SERVICE_WORDS),
    ("content_reference", CONTENT_WORDS),
)
DOCS_PRODUCTS = {"document": "docs", "spreadsheets": "sheets", "presentation": "slides"}
# ---------------------------------------------------------------------------------------------

PRIVATE_SECTION = "// ==={} PRIVATE DOMAINS==="
FULL_STOPS = "\u3002\uff0e\uff61"
ADDRESS = "^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$|:"
HOST_SALTS = 16
MAX_LENGTH = 2**31 - 1

AUTHORITY = "^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//"
HOST = AUTHORITY + "(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]*)"
PATH = AUTHORITY + "[^/?#]*([^?#]*)"


def hostname(url: Column) -> Column:
    """Lower-case host without a leading ``www.``; empty text when the url has none.

    A pattern is used because the built-in url parser gives null for urls that contain spaces.
    """
    host = F.lower(F.regexp_extract(strip(F.coalesce(url, F.lit(""))), HOST, 1))
    bare = F.replace(F.replace(host, F.lit("[")), F.lit("]"))
    return F.when(bare.startswith("www."), F.substring(bare, 5, MAX_LENGTH)).otherwise(bare)


def host_domain(url: Column, website: Column | None = None) -> Column:
    """The host, else the lower-case website name, else ``unknown``."""
    host = hostname(url)
    fallback = F.lit("unknown") if website is None else F.lower(strip(blank_to(website, "unknown")))
    return F.when(host != "", host).otherwise(fallback)


def canonical_domain(domain: Column, url: Column, website: Column | None = None) -> Column:
    """Lower/trim a recorded domain; derive it from the url when it is missing."""
    recorded = F.lower(strip(F.coalesce(domain, F.lit(""))))
    derived = host_domain(url, website)
    return blank_to(F.when(~recorded.isin("", "unknown"), recorded).otherwise(derived), "unknown")


def read_suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, private) rules of a public suffix list: one rule a line, up to the first blank.

    Lines that start with ``//`` are comments; two of them enclose the private section.
    """
    text = spark.read.text(path, wholetext=True)
    inside = f"(?s){PRIVATE_SECTION.format('BEGIN')}(.*?){PRIVATE_SECTION.format('END')}"
    sections = text.select(
        F.explode(
            F.array(
                F.struct(F.regexp_replace("value", inside, "").alias("body"), F.lit(False).alias("private")),
                F.struct(F.regexp_extract("value", inside, 1).alias("body"), F.lit(True).alias("private")),
            )
        ).alias("section")
    )
    lines = sections.select(F.explode(F.split("section.body", "\\R")).alias("line"), "section.private")
    rules = lines.where(~F.col("line").startswith("//"))
    rule = F.regexp_extract("line", "^(\\S*)", 1)
    return rules.select(rule.alias("suffix"), "private").where("suffix <> ''")


def suffix_rules(suffixes: DataFrame, private: bool = False) -> DataFrame:
    """Typed rules (tail, beyond): a host that ends in ``tail`` has a suffix of so many labels more.

    ``*.tail`` takes one label more, ``!label.tail`` one less than its own, other rules none.  Without
    ``private`` the rules so marked are left out.
    """

    def both(label: str) -> set[str]:
        if label.startswith("xn--"):
            try:
                return {label, label[4:].encode("ascii").decode("punycode")}
            except UnicodeError:
                return {label}
        return {label} if label.isascii() else {label, "xn--" + label.encode("punycode").decode()}

    def spellings(names: pd.Series) -> pd.Series:
        return names.map(lambda name: [".".join(x) for x in product(*map(both, name.split(".")))])

    if "private" in suffixes.columns and not private:
        suffixes = suffixes.where(~F.coalesce("private", F.lit(False)))
    rule = F.lower(strip(F.col("suffix")))
    rules = suffixes.select(rule.alias("rule")).where(F.col("rule") != "").distinct()
    starred, excepted = F.col("rule").startswith("*"), F.col("rule").startswith("!")
    spelled = F.pandas_udf(spellings, "array<string>")  # labels in Unicode and in Punycode
    return rules.select(
        F.explode(spelled(F.regexp_replace("rule", "^(?:\\*\\.?|!|\\.)", ""))).alias("tail"),
        F.when(starred, 1).when(excepted, -1).otherwise(0).alias("beyond"),
    ).distinct()


def registrable_domain(
    df: DataFrame,
    suffixes: DataFrame,
    host: str = "hostname",
    out: str = "registrable",
    private: bool = False,
) -> DataFrame:
    """Public suffix plus one label; hosts without a suffix, bare suffixes and addresses stay as they are.

    Of the rules (column ``suffix``, and ``private`` where marked) that a host meets an exception
    prevails, else the one of most labels.  Rules and hosts may spell labels in Unicode or Punycode.
    Only the distinct hosts are matched, each by its tails of at most as many labels as a rule has, and
    the small result is joined back.  Whether either side is broadcast is left to its measured size.
    """
    rules = suffix_rules(suffixes, private)
    # one row: labels of the longest rule, so that a host of many labels has few tails
    deepest = rules.agg(F.max(F.size(F.split("tail", "\\.")))).first()[0] or 0
    plain = F.regexp_replace(F.translate(F.col(host), FULL_STOPS, "..."), "\\.+$", "")
    hosts = df.select(host).distinct().where(~plain.rlike(ADDRESS))
    labels = hosts.select(host, F.split(plain, "\\.").alias("_labels"))
    depth = F.explode(F.sequence(F.lit(0), F.least(F.size("_labels"), F.lit(deepest)))).alias("_depth")
    tails = labels.select(host, "_labels", depth).select(
        host,
        "_labels",
        "_depth",
        F.when(F.col("_depth") == 0, F.lit(""))
        .otherwise(F.expr("array_join(slice(_labels, -_depth, _depth), '.')"))
        .alias("tail"),
    )
    size, taken = F.size("_labels"), F.col("_depth") + F.col("beyond")
    site = F.expr("slice(_labels, -(_found.taken + 1), _found.taken + 1)")
    best = (
        tails.join(rules, "tail")
        .where(taken <= size)
        .groupBy(host)
        .agg(
            F.max(F.struct((F.col("beyond") < 0).alias("excepted"), taken.alias("taken"))).alias("_found"),
            F.first("_labels").alias("_labels"),
        )
        .where((F.col("_found.taken") < size) & (F.get("_labels", size - F.col("_found.taken") - 1) != ""))
        .select(host, F.array_join(site, ".").alias("_best"))
    )
    # a host may hold a third of all rows: its rows are spread over salted copies of its one answer
    salts = F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1)))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(HOST_SALTS)))
    joined = salted.join(best.withColumn("_salt", salts), [host, "_salt"], "left")
    return joined.withColumn(out, F.coalesce("_best", F.col(host))).drop("_best", "_salt")


def registrable(df: DataFrame, suffixes: DataFrame | None, column: str = "domain") -> DataFrame:
    """Replace hosts by registrable domains; without a suffix table hosts stay as they are."""
    if suffixes is None:
        return df
    found = registrable_domain(df.withColumn("_host", F.col(column)), suffixes, "_host", "_site")
    return found.withColumn(column, F.col("_site")).select(df.columns)


def website_surface(url: Column, website: Column | None = None) -> Column:
    host = hostname(url)
    path = F.regexp_extract(strip(F.coalesce(url, F.lit(""))), PATH, 1)
    path = F.lower(F.btrim(F.regexp_replace(path, ";[^/]*$", ""), F.lit("/")))
    segment = F.split(path, "/", 2)[0]
    product = F.when(path == "", F.lit("docs")).otherwise(segment)
    for name, alias in DOCS_PRODUCTS.items():
        product = F.when(segment == name, F.lit(alias)).otherwise(product)
    site = F.lower(strip(blank_to(website if website is not None else F.lit(""), "unknown")))
    return (
        F.when(host == "docs.google.com", F.concat(product, F.lit(".google.com")))
        .when(host != "", host)
        .otherwise(blank_to(site, "unknown"))
    )


def _verdict(category, confidence, rule) -> Column:
    return F.struct(
        (category if isinstance(category, Column) else F.lit(category)).alias("website_category"),
        F.lit(confidence).alias("website_category_confidence"),
        rule.alias("website_category_rule"),
    )


def _override_chain(domain: Column, surface: Column, haystack: Column, rules: Sequence) -> Column:
    """Verdict of the first rule that hits, a branch per rule; null where none does."""
    chain = F.lit(None)
    for index, (pattern, category) in reversed(list(enumerate(rules))):
        pattern = str(pattern or "").lower()
        if not pattern:
            continue
        glob = fnmatch.translate(pattern).replace("\\Z", "\\z")
        hit = domain.rlike(glob) | surface.rlike(glob) | F.contains(haystack, F.lit(pattern))
        found = _verdict(category, "manual", F.lit(f"override:{index}:{pattern}"))
        chain = F.when(hit, found).otherwise(chain)
    return chain


def _override_table(domain: Column, surface: Column, haystack: Column, rules: Sequence) -> Column:
    """The same verdict from one expression, however many rules there are.

    Globs are keyed by their fixed text: whole names, endings (``*.example``) and beginnings
    (``shop*``) are looked up by length, and only globs of other forms are tried one by one; every
    host is judged once per batch.  Substrings are found in one pass by an automaton.
    """
    import ahocorasick

    listed = [(i, str(p or "").lower(), str(c)) for i, (p, c) in enumerate(rules)]
    listed = [row for row in listed if row[1]]
    category, pattern_of = {i: c for i, _, c in listed}, {i: p for i, p, _ in listed}
    substrings = ahocorasick.Automaton()
    keyed: dict[str, dict[str, int]] = {"whole": {}, "end": {}, "start": {}}
    others: list[tuple[int, str]] = []
    for index, pattern, _ in listed:
        if pattern not in substrings:
            substrings.add_word(pattern, index)
        body = pattern.strip("*")
        if any(c in body for c in "*?["):
            others.append((index, fnmatch.translate(pattern)))
        elif pattern[0] != "*" and pattern[-1] != "*":
            keyed["whole"].setdefault(pattern, index)
        elif pattern[0] == "*" and pattern[-1] != "*":
            keyed["end"].setdefault(body, index)
        elif pattern[0] != "*":
            keyed["start"].setdefault(body, index)
        else:
            others.append((index, fnmatch.translate(pattern)))
    if listed:
        substrings.make_automaton()
    lengths = {kind: sorted({len(key) for key in keys}) for kind, keys in keyed.items()}
    kind = "struct<website_category: string, website_category_rule: string>"

    def judge(domains: pd.Series, surfaces: pd.Series, texts: pd.Series) -> pd.DataFrame:
        tried, none = [(i, re.compile(regex)) for i, regex in others], len(category) + len(rules)
        seen: dict[str, int] = {}

        def host_rule(host: str) -> int:
            if host not in seen:
                found = [keyed["whole"].get(host, none)]
                found += [keyed["end"].get(host[len(host) - n :], none) for n in lengths["end"] if n <= len(host)]
                found += [keyed["start"].get(host[:n], none) for n in lengths["start"]]
                found += [i for i, regex in tried if regex.match(host)]
                seen[host] = min(found)
            return seen[host]

        rows = []
        for name, surface_name, text in zip(domains, surfaces, texts):
            hits = [host_rule(host) for host in (name, surface_name) if host is not None]
            if category and text is not None:
                hits += [index for _, index in substrings.iter(text)]
            best = min(hits, default=none)
            rows.append(
                (category[best], f"override:{best}:{pattern_of[best]}") if best in category else (None, None)
            )
        return pd.DataFrame(rows, columns=["website_category", "website_category_rule"])

    found = F.pandas_udf(judge, kind)(domain, surface, haystack)
    return F.when(
        found["website_category"].isNotNull(),
        _verdict(found["website_category"], "manual", found["website_category_rule"]),
    )


def classify_website(
    domain: Column,
    surface: Column,
    url: Column,
    rules: Sequence[tuple[str, str]] = (),
    rule_table: bool = False,
) -> Column:
    """Struct of category, confidence and rule.

    ``rules`` are ordered (pattern, category) overrides from a configuration: a glob on the domain or
    surface, or a substring of all three texts.  A few of them are plain branches; for thousands,
    ``rule_table`` looks them up instead, with the same verdicts.  The vocabularies follow in a fixed
    order, each giving its alphabetically first matching token.
    """
    haystack = F.lower(F.concat_ws(" ", domain, surface, F.coalesce(url, F.lit(""))))
    # plain replacements: translate() walks a text character by character
    dotted = F.replace(F.replace(haystack, F.lit("/"), F.lit(".")), F.lit("-"), F.lit("."))
    tokens = F.split(dotted, "\\.")
    every = [word for _, words in VOCABULARIES for word in words]

    def judged(listed: Column) -> Column:
        fallback = _verdict("general_web", "unknown", F.lit("fallback"))
        chain = fallback
        for category, words in reversed(VOCABULARIES):
            first = F.array_min(F.filter(listed, lambda token: token.isin(*words)))
            found = _verdict(category, "heuristic", F.concat(F.lit("url-token:"), first))
            chain = F.when(first.isNotNull(), found).otherwise(chain)
        return F.when(F.size(listed) > 0, chain).otherwise(fallback)

    # Few texts hold a listed word: tokens meet one fixed set once, and only hits meet the vocabularies.
    chain = bound(F.filter(tokens, lambda token: token.isin(*every)), judged)
    if not rules:
        return chain
    override = (_override_table if rule_table else _override_chain)(domain, surface, haystack, rules)
    return F.coalesce(override, chain)


def application_focused(category: Column) -> Column:
    return category.isin(*APPLICATION_CATEGORIES)
