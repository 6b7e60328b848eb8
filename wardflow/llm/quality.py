"""Quality rules: text counts, rule failures of a host, shrunken rates, verdicts for documents.

Only DataFrame functions. The counts of a text are computed inside its row, so a long text
costs n log n and no shuffle; the table of counts is written once and read twice, for the
hosts and for the verdicts.

Defined results: a null text has no words; a null host belongs to no host and is judged by
its own rules alone; repeated rows count as often as they occur; an empty table gives an
empty table. Other columns are not read, whatever their names.
"""

from pyspark.sql import functions as F

from wardflow.llm.stages import let, stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text):
    """Array of the words of a text column."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _covered(starts, width):
    """Words inside windows that begin at the given sorted positions."""
    gaps = F.transform(starts, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - x, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeat_words(words):
    """Words in 3-word windows that occur twice or more in the array, the first included."""

    def windows(h):
        body = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
        return F.sort_array(F.transform(body, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))))

    def starts(w):
        def twice(x, i):
            return F.coalesce(x.h == F.get(w, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(w, i + 1).h, F.lit(False))

        return F.sort_array(F.transform(F.filter(w, twice), lambda x: x.i))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(windows(h), lambda w: let(starts(w), lambda s: _covered(s, 3))))


def text_counts(docs, text="text"):
    """docs with the counts of COUNTS added, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = let(
        words_of(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    return (
        docs.withColumn("_counts", counts)
        .withColumn("n_words", F.col("_counts.n_words"))
        .withColumn("word_chars", F.length(F.translate(body, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("_counts.n_repeat_words"))
        .drop("_counts")
    )


def rule_failures():
    """Name and condition of each rule, on the columns of text_counts."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "long_words": F.col("word_chars") > 20 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > n,
    }


def beta_priors(hosts, rules, max_strength=1e6):
    """Mean and strength of the beta prior of each rule, from the moments over all hosts.

    Every host is weighted by its documents: m is the overall failure rate, v the variance of
    the host rates, and the strength m (1 - m) / v - 1, held between 0 and max_strength, which
    is also the strength where hosts do not differ. One row of sums reaches the driver.
    """
    n = F.col("n_docs")
    sums = [F.sum(n).alias("n")]
    for r in rules:
        sums += [F.sum(f"k_{r}").alias(f"k_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"q_{r}")]
    row = hosts.agg(*sums).first()
    priors = {}
    for r in rules:
        if not row["n"]:
            priors[r] = (0.0, max_strength)
            continue
        m = row[f"k_{r}"] / row["n"]
        v = row[f"q_{r}"] / row["n"] - m * m
        strength = m * (1 - m) / v - 1 if v > 1e-12 else max_strength
        priors[r] = (m, min(max(strength, 0.0), max_strength))
    return priors


def host_rates(counts, host="source", rules=None):
    """One row for each host: n_docs and rate_<rule>, the failure rate shrunk to its prior."""
    rules = rules or rule_failures()
    failures = [F.sum(F.when(rule, 1).otherwise(0)).alias(f"k_{r}") for r, rule in rules.items()]
    hosts = counts.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    priors = beta_priors(hosts, list(rules))
    rates = [((F.col(f"k_{r}") + m * s) / (F.col("n_docs") + s)).alias(f"rate_{r}") for r, (m, s) in priors.items()]
    return hosts.select(host, "n_docs", *rates)


def judge(counts, host="source", max_rate=0.5, rules=None):
    """counts with base_failed, host_failed (a rule fails on most of the host) and kept.

    counts is a stored table of text_counts. Base rules are few_words and repeats.
    """
    rules = rules or rule_failures()
    rates = host_rates(counts, host, rules)
    bad = rates.select(host, F.greatest(*[F.col(f"rate_{r}") for r in rules], F.lit(0.0)).alias("_worst"))
    judged = counts.join(bad, host, "left")
    host_failed = F.coalesce(F.col("_worst") > max_rate, F.lit(False))
    base = rules["few_words"] | rules["repeats"]
    return judged.withColumn("base_failed", base).withColumn("host_failed", host_failed).withColumn("kept", ~base & ~host_failed).drop("_worst")


def document_verdicts(docs, key="doc_id", text="text", host="source", max_rate=0.5):
    """key, the counts, base_failed, host_failed and kept of every document."""
    narrow = docs.select(key, F.col(host), F.col(text))
    counts = stored(text_counts(narrow, text).drop(text), "quality")
    return judge(counts, host, max_rate).select(key, *COUNTS, "base_failed", "host_failed", "kept")


def keep_good(docs, text="text", host="source", max_rate=0.5):
    """The documents that pass, with their own columns. Each row is judged by itself."""
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    judged = judge(stored(text_counts(row, "_text").drop("_text"), "quality"), "_host", max_rate)
    return judged.filter("kept").select("_row.*")
