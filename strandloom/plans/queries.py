"""Registered queries of the sequence operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import codon_usage as cu
from strandloom.operators import design, metrics, motifs, qc, selection
from strandloom.plans.problems import table
from strandloom.workspace import keep

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, tuple[Query, str | None]] = {}

PLACES = 9


def _r(c: Column | str) -> Column:
    return F.round(c, PLACES)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _registered[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _registered.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered.items() if sql}


_CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in seq.CODE.items()) + ")"
_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in seq.CODE.items()) + "}"
_VALID = r"""
valid AS (
  SELECT trim(locus_tag) AS locus_tag, upper(trim(nucleotide_seq)) AS dna, product FROM cds
  WHERE trim(locus_tag) <> '' AND length(trim(nucleotide_seq)) > 0 AND length(trim(nucleotide_seq)) % 3 = 0
    AND NOT regexp_matches(left(upper(trim(nucleotide_seq)), length(trim(nucleotide_seq)) - 3),
      '^(?:.{3})*(?:TAA|TAG|TGA)')
  QUALIFY row_number() OVER (PARTITION BY trim(locus_tag) ORDER BY added_at NULLS FIRST,
    upper(trim(nucleotide_seq)), location NULLS FIRST, product NULLS FIRST) = 1)"""
_USAGE = r"""
counts AS (
  SELECT c.codon, c.aa, count(x.codon) AS n FROM code c
  LEFT JOIN (SELECT unnest(regexp_extract_all(dna, '.{3}')) AS codon FROM valid) x ON x.codon = c.codon
  GROUP BY c.codon, c.aa),
usage AS (
  SELECT codon, aa, n,
    CASE WHEN sum(n) OVER f > 0 THEN n / sum(n) OVER f ELSE 0.0 END AS frequency,
    CASE WHEN count(*) OVER f = 1 THEN 1.0 WHEN max(n) OVER f = 0 OR n = 0 THEN 0.01 ELSE n / max(n) OVER f END AS w,
    CASE WHEN sum(n) OVER f > 0 THEN n * count(*) OVER f / sum(n) OVER f ELSE 0.0 END AS rscu
  FROM counts WINDOW f AS (PARTITION BY aa)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY aa ORDER BY w DESC, codon) - 1 AS rank FROM usage)"""
_HOST = f"WITH {_CODE}, {_VALID}, {_USAGE}"


def _cds(spark: SparkSession, folder: str) -> DataFrame:
    return cu.valid_cds(table(spark, folder, "cds"))


def _host(spark: SparkSession, folder: str) -> DataFrame:
    return cu.host_table(table(spark, folder, "cds"))


def _weights(spark: SparkSession, folder: str) -> dict[str, float]:
    return cu.weights(_host(spark, folder))


@_query(f"{_HOST} SELECT codon, aa AS amino_acid, n AS count FROM counts")
def codon_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cu.codon_counts(_cds(spark, folder))


@_query(
    f"{_HOST} SELECT codon, aa AS amino_acid, n AS count, round(frequency, 9) AS frequency, round(w, 9) AS w_i, "
    "round(rscu, 9) AS rscu FROM usage"
)
def codon_usage_table(spark: SparkSession, folder: str) -> DataFrame:
    found = cu.codon_usage(_cds(spark, folder))
    return found.withColumns({c: _r(c) for c in ("frequency", "w_i", "rscu")})


@_query(f"""WITH {_CODE},
  found AS (
    SELECT target_idx, codon, count(*) AS n FROM (
      SELECT target_idx, unnest(regexp_extract_all(upper(original_dna), '.{{3}}')) AS codon FROM targets)
    GROUP BY ALL),
  families AS (SELECT DISTINCT target_idx, aa FROM found JOIN code USING (codon)),
  counts AS (
    SELECT f.target_idx, c.codon, f.aa, coalesce(x.n, 0) AS n FROM families f JOIN code c ON c.aa = f.aa
    LEFT JOIN found x ON x.target_idx = f.target_idx AND x.codon = c.codon)
  SELECT target_idx, codon, aa AS amino_acid, n AS count,
    round(n / sum(n) OVER f, 9) AS frequency,
    round(CASE WHEN count(*) OVER f = 1 THEN 1.0 WHEN n = 0 THEN 0.01 ELSE n / max(n) OVER f END, 9) AS w_i,
    round(n * count(*) OVER f / sum(n) OVER f, 9) AS rscu
  FROM counts WINDOW f AS (PARTITION BY target_idx, aa)""")
def usage_per_target(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "targets").where("original_dna is not null")
    found = cu.usage_per_sequence(targets, "target_idx", "original_dna")
    return found.withColumns({c: _r(c) for c in ("frequency", "w_i", "rscu")})


@_query(f"{_HOST} SELECT aa AS amino_acid, codon, rank FROM ranks")
def synonym_rank(spark: SparkSession, folder: str) -> DataFrame:
    return cu.synonym_ranks(_host(spark, folder)).select("amino_acid", "codon", "rank")


@_query(f"WITH {_VALID} SELECT round(coalesce(sum(length(regexp_replace(dna, '[^GC]', '', 'g'))) / sum(length(dna)), 0), 9) "
        "AS host_gc FROM valid")  # fmt: skip
def host_gc(spark: SparkSession, folder: str) -> DataFrame:
    return cu.host_gc(_cds(spark, folder)).select(_r("host_gc").alias("host_gc"))


@_query(f"""SELECT locus_tag, location, contig, array_to_string(list_transform(
    regexp_extract_all(upper(nucleotide_seq), '.{{3}}'), lambda c: coalesce(({_MAP})[c], 'X')), '') AS protein FROM cds""")
def translate_dna(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cds").select(
        "locus_tag", "location", "contig", seq.translate(F.col("nucleotide_seq")).alias("protein")
    )


@_query("SELECT target_idx, reverse(translate(original_dna, 'ACGTacgt', 'TGCAtgca')) AS reverse_dna FROM targets "
        "WHERE original_dna IS NOT NULL")  # fmt: skip
def reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    dna = table(spark, folder, "targets").where("original_dna is not null")
    return dna.select("target_idx", seq.reverse_complement(F.col("original_dna")).alias("reverse_dna"))


@_query("""SELECT target_idx, variant_number, round(CASE WHEN length(dna_sequence) > 0 THEN
    length(regexp_replace(upper(dna_sequence), '[^GC]', '', 'g')) / length(dna_sequence) ELSE 0.0 END, 9) AS gc
    FROM variants""")
def gc_content(spark: SparkSession, folder: str) -> DataFrame:
    dna = F.col("dna_sequence")
    return table(spark, folder, "variants").select("target_idx", "variant_number", _r(seq.gc_content(dna)).alias("gc"))


@_query("""SELECT input_type, CASE WHEN regexp_full_match(s, '[ACGTNacgtn]+') THEN 'dna' ELSE 'protein' END AS found_type,
    count(*) AS n FROM (SELECT input_type, coalesce(original_dna, protein_seq) AS s FROM targets) GROUP BY ALL""")
def seq_type_detect(spark: SparkSession, folder: str) -> DataFrame:
    given = F.coalesce("original_dna", "protein_seq")
    kind = F.when(seq.is_dna(given), "dna").otherwise("protein")
    found = table(spark, folder, "targets").select("input_type", kind.alias("found_type"))
    return found.groupBy("input_type", "found_type").agg(F.count("*").alias("n"))


@_query("""WITH p AS (SELECT input_type, regexp_replace(upper(protein_seq), '[*]+$', '') AS p FROM targets)
    SELECT input_type, CASE WHEN coalesce(length(p), 0) = 0 THEN 'empty' WHEN regexp_matches(p, '[BJOUXZ]') THEN 'ambiguous'
      WHEN NOT regexp_full_match(p, '[ACDEFGHIKLMNPQRSTVWY]+') THEN 'non_standard' END AS problem, count(*) AS n
    FROM p GROUP BY ALL""")
def protein_validation(spark: SparkSession, folder: str) -> DataFrame:
    problem = design.protein_problem(F.col("protein_seq"))
    found = table(spark, folder, "targets").select("input_type", problem.alias("problem"))
    return found.groupBy("input_type", "problem").agg(F.count("*").alias("n"))


@_query(r"""WITH d AS (SELECT locus_tag, upper(trim(nucleotide_seq)) AS dna FROM cds)
    SELECT CASE WHEN coalesce(trim(locus_tag), '') = '' THEN 'no_locus_tag'
      WHEN coalesce(length(dna), 0) = 0 THEN 'no_sequence' WHEN length(dna) % 3 <> 0 THEN 'partial_codon'
      WHEN regexp_matches(left(dna, length(dna) - 3), '^(?:.{3})*(?:TAA|TAG|TGA)') THEN 'inner_stop' END AS reason,
      count(*) AS n FROM d GROUP BY ALL""")
def cds_validation(spark: SparkSession, folder: str) -> DataFrame:
    return cu.checked_cds(table(spark, folder, "cds")).groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"WITH {_VALID} SELECT locus_tag, dna AS nucleotide_seq FROM valid")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return _cds(spark, folder).select("locus_tag", "nucleotide_seq")


_EXPRESSION = r"""
once AS (
  SELECT source, trim(locus_tag, ' ' || chr(9) || chr(10) || chr(13)) AS locus_tag, expr_id, max(RPKM_average) AS rpkm
  FROM expression WHERE RPKM_average >= 0 AND NOT isnan(RPKM_average) AND source IS NOT NULL
  GROUP BY ALL),
genes AS (SELECT source, locus_tag, avg(rpkm) AS rpkm FROM once WHERE locus_tag <> '' GROUP BY source, locus_tag)"""


@_query(f"WITH {_EXPRESSION} SELECT source, locus_tag, round(rpkm, 9) AS rpkm FROM genes")
def expression_table(spark: SparkSession, folder: str) -> DataFrame:
    found = selection.expression_table(table(spark, folder, "expression"))
    return found.withColumn("rpkm", _r("rpkm"))


@_query(f"""WITH {_VALID}, {_EXPRESSION} SELECT g.source, count(*) AS n_tags, count(v.locus_tag) AS n_matched,
    round(count(v.locus_tag) / count(*), 9) AS match_rate
    FROM genes g LEFT JOIN valid v ON g.locus_tag = v.locus_tag GROUP BY g.source""")
def match_rate(spark: SparkSession, folder: str) -> DataFrame:
    genes = selection.expression_table(table(spark, folder, "expression"))
    found = selection.match_rates(genes, _cds(spark, folder))
    return found.withColumn("match_rate", _r("match_rate"))


@_query(f"""WITH {_VALID}, {_EXPRESSION},
  ranked AS (
    SELECT g.source, g.locus_tag, row_number() OVER (PARTITION BY g.source ORDER BY g.rpkm DESC, g.locus_tag) AS rank,
      count(*) OVER (PARTITION BY g.source) AS n
    FROM genes g JOIN valid v ON g.locus_tag = v.locus_tag WHERE length(v.dna) >= 500),
  wanted AS (
    SELECT *, greatest(1, round_even(n * 10.0 / 100, 0)) AS n_few, greatest(1, round_even(n * 20.0 / 100, 0)) AS n_more
    FROM ranked)
  SELECT source, locus_tag, rank, (n_few < 30) AS expanded FROM wanted
  WHERE rank <= CASE WHEN n_few < 30 THEN n_more ELSE n_few END""")
def reference_top_expressed(spark: SparkSession, folder: str) -> DataFrame:
    genes = selection.expression_table(table(spark, folder, "expression"))
    found = selection.top_expressed(genes, _cds(spark, folder))
    return found.select("source", "locus_tag", "rank", "expanded")


_KEYWORDS = "[" + ", ".join(f"'{w.lower()}'" for w in selection.HOUSEKEEPING) + "]"


@_query(f"""WITH {_VALID},
  marked AS (
    SELECT locus_tag, length(dna) >= 500 AS long, len(list_filter({_KEYWORDS},
      lambda w: contains(lower(coalesce(product, '')), w))) > 0 AS named FROM valid),
  n AS (SELECT count(*) FILTER (long AND named) AS n_named, count(*) FILTER (long) AS n_long FROM marked)
  SELECT locus_tag, CASE WHEN n_named >= 20 THEN 'housekeeping' WHEN n_long > 0 THEN 'all_cds_fallback'
    ELSE 'all_cds' END AS mode
  FROM marked, n WHERE CASE WHEN n_named >= 20 THEN long AND named WHEN n_long > 0 THEN long ELSE true END""")
def reference_housekeeping(spark: SparkSession, folder: str) -> DataFrame:
    return selection.housekeeping(_cds(spark, folder)).select("locus_tag", "mode")


@_query(f"""{_HOST},
  scored AS (SELECT codon, ln(w) AS l FROM usage WHERE aa NOT IN ('*', 'M', 'W')),
  items AS (SELECT row_number() OVER () AS id, target_idx, variant_number, dna_sequence FROM variants),
  means AS (
    SELECT id, avg(s.l) AS m FROM (
      SELECT id, unnest(regexp_extract_all(upper(dna_sequence), '.{{3}}')) AS codon FROM items) x
    JOIN scored s ON s.codon = x.codon GROUP BY id)
  SELECT target_idx, variant_number, round(CASE WHEN length(dna_sequence) % 3 = 0 THEN coalesce(exp(m), 1.0) END, 6) AS cai
  FROM items LEFT JOIN means USING (id)""")
def cai(spark: SparkSession, folder: str) -> DataFrame:
    score = metrics.cai(F.col("dna_sequence"), _weights(spark, folder))
    return table(spark, folder, "variants").select("target_idx", "variant_number", F.round(score, 6).alias("cai"))


@_query(f"""WITH {_CODE}, {_VALID},
  sizes AS (SELECT codon, aa, count(*) OVER (PARTITION BY aa) AS k FROM code WHERE aa <> '*'),
  per_codon AS (
    SELECT locus_tag, s.aa, s.k, s.codon, count(*) AS n FROM (
      SELECT locus_tag, unnest(regexp_extract_all(dna, '.{{3}}')) AS codon FROM valid) x
    JOIN sizes s ON s.codon = x.codon WHERE s.k > 1 GROUP BY ALL),
  per_family AS (
    SELECT locus_tag, aa, k, sum(n) AS n, sum(n * n) AS sq FROM per_codon GROUP BY locus_tag, aa, k),
  f AS (
    SELECT locus_tag, k, avg(CASE WHEN n <= 1 THEN 1.0 ELSE greatest((k * (sq / (n * n)) - 1) / (k - 1), 1 / k) END) AS f
    FROM per_family GROUP BY locus_tag, k),
  wide AS (
    SELECT locus_tag, max(f) FILTER (k = 2) AS f2, max(f) FILTER (k = 3) AS f3, max(f) FILTER (k = 4) AS f4,
      max(f) FILTER (k = 6) AS f6 FROM f GROUP BY locus_tag)
  SELECT locus_tag, round(least(61.0, 2.0 + coalesce(9 / f2, 0) + coalesce(1 / coalesce(f3, (f2 + f4) / 2), 0)
    + coalesce(5 / f4, 0) + coalesce(3 / f6, 0)), 6) AS nc FROM wide""")
def effective_codons(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.effective_codons(_cds(spark, folder), "locus_tag", "nucleotide_seq")
    return found.select("locus_tag", F.round("nc", 6).alias("nc"))


_BEST = "best AS (SELECT aa, codon, w FROM ranks WHERE rank = 0)"
_PROTEINS = r"proteins AS (SELECT *, regexp_replace(upper(protein_seq), '[*]+$', '') AS p FROM targets)"


@_query(f"""{_HOST}, {_BEST}, {_PROTEINS},
  letters AS (SELECT target_idx, unnest(string_split(p, '')) AS aa, generate_subscripts(string_split(p, ''), 1) AS i
    FROM proteins WHERE p <> '')
  SELECT l.target_idx, string_agg(b.codon, '' ORDER BY l.i) || 'TAA' AS dna FROM letters l JOIN best b ON b.aa = l.aa
  GROUP BY l.target_idx""")
def max_cai(spark: SparkSession, folder: str) -> DataFrame:
    sound = table(spark, folder, "targets").where(design.protein_problem(F.col("protein_seq")).isNull())
    return sound.select("target_idx", design.max_cai(F.col("protein_seq"), _weights(spark, folder)).alias("dna"))


@_query(f"""{_HOST}, {_BEST}, {_PROTEINS},
  positions AS (
    SELECT target_idx, unnest(regexp_extract_all(upper(original_dna), '.{{3}}')) AS codon,
      generate_subscripts(regexp_extract_all(upper(original_dna), '.{{3}}'), 1) AS position,
      string_split(p, '') AS ps FROM proteins WHERE original_dna IS NOT NULL AND p <> '')
  SELECT x.target_idx, x.position, x.codon AS original_codon, u.aa AS amino_acid,
    round(u.w, 9) AS original_w_i, coalesce(b.codon, 'TAA') AS optimized_codon, x.codon <> coalesce(b.codon, 'TAA') AS changed
  FROM positions x LEFT JOIN usage u ON u.codon = x.codon LEFT JOIN best b ON b.aa = x.ps[x.position]
  WHERE x.position <= len(x.ps) + 1""")
def compare_codons(spark: SparkSession, folder: str) -> DataFrame:
    w = _weights(spark, folder)
    targets = table(spark, folder, "targets").where(design.protein_problem(F.col("protein_seq")).isNull())
    designed = targets.withColumn("dna", design.max_cai(F.col("protein_seq"), w))
    found = metrics.compared_codons(designed, "target_idx", "original_dna", "dna", w)
    return found.select(
        "target_idx", "position", "original_codon", "amino_acid", _r("original_w_i").alias("original_w_i"),
        "optimized_codon", "changed",
    )


@_query(f"""{_HOST},
  shares AS (SELECT aa, codon, w, w / sum(w) OVER (PARTITION BY aa) AS share FROM usage),
  flat AS (SELECT *, pow(greatest(share, 1e-12), 1 / 1.5) AS r FROM shares),
  flat2 AS (SELECT *, r / sum(r) OVER (PARTITION BY aa) AS flat_share FROM flat)
  SELECT aa AS amino_acid, codon, round(share, 9) AS share, round(flat_share, 9) AS flat_share,
    round(sum(flat_share) OVER (PARTITION BY aa ORDER BY w DESC, codon ROWS UNBOUNDED PRECEDING), 9) AS flat_to FROM flat2""")
def temperature_shares(spark: SparkSession, folder: str) -> DataFrame:
    found = design.temperature_shares(_host(spark, folder), 1.5)
    return found.withColumns({c: _r(c) for c in ("share", "flat_share", "flat_to")})


_DRAWS = f"""{_HOST}, {_PROTEINS},
  shares AS (SELECT aa, codon, w, rank, w / sum(w) OVER (PARTITION BY aa) AS p FROM ranks),
  raised AS (SELECT *, pow(greatest(p, 1e-12), 1 / 1.5) AS r, pow(greatest(p, 1e-12), 1.0) AS q FROM shares),
  ends AS (
    SELECT aa, codon, rank, max(rank) OVER (PARTITION BY aa) AS last,
      sum(r) OVER o / sum(r) OVER (PARTITION BY aa) AS flat_to, sum(q) OVER o / sum(q) OVER (PARTITION BY aa) AS plain_to
    FROM raised WINDOW o AS (PARTITION BY aa ORDER BY rank ROWS UNBOUNDED PRECEDING))"""


def _u(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"


@_query(f"""{_DRAWS},
  letters AS (
    SELECT target_idx, c.candidate, unnest(string_split(p, '')) AS aa, generate_subscripts(string_split(p, ''), 1) - 1 AS i
    FROM proteins, (SELECT unnest([0, 1, 2]) AS candidate) c WHERE p <> ''),
  drawn AS (
    SELECT *, {_u("'11|' || target_idx || '|' || candidate || '|' || i")} AS u FROM letters),
  picked AS (
    SELECT d.target_idx, d.candidate, d.i, min_by(e.codon, e.rank) AS codon FROM drawn d JOIN ends e ON e.aa = d.aa
      AND (e.rank = e.last OR d.u < CASE WHEN d.i < 30 THEN e.flat_to ELSE e.plain_to END)
    GROUP BY ALL)
  SELECT target_idx, candidate, string_agg(codon, '' ORDER BY i) || 'TAA' AS dna FROM picked GROUP BY target_idx, candidate""")
def weighted_design(spark: SparkSession, folder: str) -> DataFrame:
    sound = table(spark, folder, "targets").where(design.protein_problem(F.col("protein_seq")).isNull())
    seed = F.concat_ws("|", F.lit("11"), "target_idx", "candidate")
    dna = design.weighted(F.col("protein_seq"), _weights(spark, folder), seed)
    return design.candidates(sound.select("target_idx", "protein_seq"), 3).select("target_idx", "candidate", dna.alias("dna"))


@_query(f"""{_DRAWS},
  bodies AS (
    SELECT target_idx, regexp_extract_all(regexp_replace(upper(original_dna), '(TAA|TAG|TGA)$', ''), '.{{3}}') AS cs
    FROM targets WHERE original_dna IS NOT NULL),
  positions AS (SELECT target_idx, unnest(cs) AS codon, generate_subscripts(cs, 1) - 1 AS i FROM bodies),
  drawn AS (
    SELECT x.*, c.aa, {_u("'5|' || target_idx || '|noise|' || i")} AS chance, {_u("'5|' || target_idx || '|' || i")} AS u
    FROM positions x JOIN code c ON c.codon = x.codon),
  picked AS (
    SELECT d.target_idx, d.i, d.codon, d.chance, min_by(e.codon, e.rank) AS other FROM drawn d
    JOIN ends e ON e.aa = d.aa AND (e.rank = e.last OR d.u < e.plain_to) GROUP BY ALL)
  SELECT target_idx, string_agg(CASE WHEN chance < 0.1 THEN other ELSE codon END, '' ORDER BY i) || 'TAA' AS dna
  FROM picked GROUP BY target_idx""")
def harmonized_design(spark: SparkSession, folder: str) -> DataFrame:
    """Here source and host are one genome, so a codon changes by noise alone; unit tests cover two genomes."""
    w = _weights(spark, folder)
    dna = design.harmonized(F.col("original_dna"), w, w, F.concat_ws("|", F.lit("5"), "target_idx"))
    return table(spark, folder, "targets").where("original_dna is not null").select("target_idx", dna.alias("dna"))


_SCORE = """0.5 * greatest(0, least(1, cai_score)) + 0.3 * (1 - least(1, abs(gc_content - 0.4) / 0.5))
    + 0.2 * CASE WHEN mfe_5prime IS NULL THEN 1.0 ELSE 1 - least(1, abs(mfe_5prime) / 30.0) END"""


@_query(f"""SELECT target_idx, variant_number, round({_SCORE}, 9) AS score,
    round({_SCORE} - 0.05 * coalesce(len(forbidden_hits), 0), 9) AS penalised FROM variants""")
def composite_score(spark: SparkSession, folder: str) -> DataFrame:
    score = metrics.composite_score(F.col("cai_score"), F.col("gc_content"), F.col("mfe_5prime"), 0.4)
    hits = F.size(F.coalesce("forbidden_hits", F.array().cast("array<string>")))
    return table(spark, folder, "variants").select(
        "target_idx", "variant_number", _r(score).alias("score"), _r(metrics.penalised(score, hits)).alias("penalised")
    )


_RANKED = """
once AS (
  SELECT target_idx, variant_number, coalesce(len(forbidden_hits), 0) = 0 AS clean,
    NOT coalesce(has_strong_structure, false) AS unstructured, composite_score FROM variants
  WHERE composite_score IS NOT NULL AND NOT isnan(composite_score)
  QUALIFY row_number() OVER (PARTITION BY target_idx, variant_number
    ORDER BY coalesce(len(forbidden_hits), 0) = 0 DESC, NOT coalesce(has_strong_structure, false) DESC,
      composite_score DESC) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_idx
    ORDER BY clean DESC, unstructured DESC, composite_score DESC, variant_number) AS rank FROM once)"""


@_query(f"WITH {_RANKED} SELECT target_idx, variant_number, rank FROM ranked WHERE rank <= 3")
def variant_rank(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.ranked_variants(table(spark, folder, "variants"), 3)
    return found.select("target_idx", "variant_number", "rank")


@_query(f"""WITH {_RANKED},
  names AS (SELECT target_idx, variant_number, any_value(mode) AS mode, array_to_string(list_sort(list_distinct(
    flatten(list(coalesce(forbidden_hits, []))))), ', ') AS forbidden_motifs FROM variants GROUP BY target_idx, variant_number)
  SELECT t.target_idx, regexp_extract(trim(t.header), '^[^ \\t]*') AS sequence_name, r.variant_number, n.forbidden_motifs
  FROM ranked r JOIN targets t ON t.target_idx = r.target_idx
  JOIN names n ON n.target_idx = r.target_idx AND n.variant_number = r.variant_number WHERE r.rank = 1""")
def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    variants = table(spark, folder, "variants")
    best = metrics.ranked_variants(variants, 1).select("target_idx", "variant_number")
    motif = F.explode_outer("forbidden_hits").alias("motif")
    named = variants.select("target_idx", "variant_number", motif).join(best, ["target_idx", "variant_number"])
    names = named.groupBy("target_idx", "variant_number").agg(
        F.array_join(F.array_sort(F.collect_set("motif")), ", ").alias("forbidden_motifs")
    )
    name = F.regexp_extract(F.trim("header"), r"^[^ \t]*", 0).alias("sequence_name")
    return names.join(table(spark, folder, "targets").select("target_idx", name), "target_idx").select(
        "target_idx", "sequence_name", "variant_number", "forbidden_motifs"
    )


def _motif_sql() -> str:
    parts = []
    for name, pattern, both in motifs.MOTIFS:
        strands = [("+", "u")] + ([("-", "reverse(translate(u, 'ACGT', 'TGCA'))")] if both else [])
        for strand, text in strands:
            parts.append(
                f"SELECT locus_tag, '{name}' AS motif, '{strand}' AS strand, length(u) AS n, "
                f"string_split_regex({text}, '{pattern}') AS between, regexp_extract_all({text}, '{pattern}') AS found FROM s"
            )
    union = " UNION ALL ".join(parts)
    return f"""WITH {_VALID}, s AS (SELECT locus_tag, dna AS u FROM valid), m AS ({union}),
      hits AS (
        SELECT locus_tag, motif, strand, n, between, found, unnest(found) AS matched, generate_subscripts(found, 1) AS i
        FROM m WHERE len(found) > 0),
      placed AS (
        SELECT *, list_sum(list_transform(between[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM hits)
      SELECT locus_tag, motif, strand, CAST(CASE strand WHEN '+' THEN start ELSE n - start - length(matched) END AS INT)
        AS hit_start, CAST(CASE strand WHEN '+' THEN start + length(matched) ELSE n - start END AS INT) AS hit_end, matched
      FROM placed"""


@_query(_motif_sql())
def motif_hits(spark: SparkSession, folder: str) -> DataFrame:
    return motifs.motif_hits(_cds(spark, folder), "locus_tag", "nucleotide_seq")


@_query()
def motif_repair(spark: SparkSession, folder: str) -> DataFrame:
    genes = _cds(spark, folder).select("locus_tag", "nucleotide_seq")
    return motifs.repaired(genes, "locus_tag", "nucleotide_seq", _weights(spark, folder))


@_query()
def repair_delta(spark: SparkSession, folder: str) -> DataFrame:
    w = _weights(spark, folder)
    genes = keep(_cds(spark, folder).select("locus_tag", "nucleotide_seq"), "genes")
    after = motifs.repaired(genes, "locus_tag", "nucleotide_seq", w)
    dna = F.col("nucleotide_seq")
    one = genes.select("locus_tag", metrics.cai(dna, w).alias("cai_before"), seq.translate(dna).alias("protein"))
    other = after.select("locus_tag", metrics.cai(dna, w).alias("cai_after"), seq.translate(dna).alias("protein_after"),
                         "rounds", "has_hits")
    return one.join(other, "locus_tag").select(
        "locus_tag", "rounds", "has_hits", _r(F.col("cai_after") - F.col("cai_before")).alias("delta_cai"),
        (F.col("protein") == F.col("protein_after")).alias("same_protein"),
    )


_WINDOWS = f"""WITH {_VALID},
  places AS (
    SELECT locus_tag, dna, length(regexp_replace(dna, '[^GC]', '', 'g')) / length(dna) AS overall,
      unnest(range(0, greatest(length(dna) - 49, 1))) AS pos FROM valid),
  shares AS (
    SELECT locus_tag, overall, pos, length(dna) AS n, CASE WHEN length(dna) >= 50
      THEN length(regexp_replace(dna[pos + 1:pos + 50], '[^GC]', '', 'g')) / 50 ELSE overall END AS gc FROM places)"""


@_query(f"""{_WINDOWS} SELECT locus_tag, round(any_value(overall), 9) AS overall_gc, round(min(gc), 9) AS min_gc,
    round(max(gc), 9) AS max_gc, any_value(overall) BETWEEN 0.25 AND 0.65 AS gc_ok FROM shares GROUP BY locus_tag""")
def gc_sliding(spark: SparkSession, folder: str) -> DataFrame:
    found = qc.gc_extremes(_cds(spark, folder), "locus_tag", "nucleotide_seq")
    return found.withColumns({c: _r(c) for c in ("overall_gc", "min_gc", "max_gc")})


@_query(f"""{_WINDOWS},
  far AS (
    SELECT *, CASE WHEN gc > overall THEN 'high' ELSE 'low' END AS direction FROM shares
    WHERE n >= 50 AND abs(gc - overall) > 0.15),
  marked AS (
    SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR lag(direction) OVER o <> direction OR pos - lag(pos) OVER o > 50
      THEN 1 ELSE 0 END AS new FROM far WINDOW o AS (PARTITION BY locus_tag ORDER BY pos)),
  islands AS (SELECT *, sum(new) OVER (PARTITION BY locus_tag ORDER BY pos) AS island FROM marked)
  SELECT locus_tag, direction, CAST(min(pos) AS INT) AS region_start, CAST(max(pos) + 50 AS INT) AS region_end,
    round(min_by(gc, pos), 9) AS gc FROM islands GROUP BY locus_tag, island, direction""")
def gc_regions(spark: SparkSession, folder: str) -> DataFrame:
    found = qc.gc_regions(_cds(spark, folder), "locus_tag", "nucleotide_seq")
    return found.withColumn("gc", _r("gc"))


_RUNS = "|".join(f"{b}{{7,}}" for b in "ACGTN")


@_query(f"""WITH {_VALID},
  r AS (
    SELECT locus_tag, regexp_extract_all(dna, '{_RUNS}') AS runs, string_split_regex(dna, '{_RUNS}') AS between FROM valid),
  u AS (SELECT *, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM r)
  SELECT locus_tag, run[1] AS base, length(run) AS run_length,
    CAST(list_sum(list_transform(between[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(runs[1:i - 1], lambda x: length(x))), 0) AS INT) AS run_start FROM u""")
def homopolymers(spark: SparkSession, folder: str) -> DataFrame:
    return qc.homopolymers(_cds(spark, folder), "locus_tag", "nucleotide_seq")


@_query(f"""WITH {_VALID},
  places AS (SELECT locus_tag, unnest(range(0, length(dna) - 11)) AS pos, dna FROM valid WHERE length(dna) >= 24),
  kmers AS (SELECT locus_tag, pos, dna[pos + 1:pos + 12] AS kmer FROM places),
  nth AS (
    SELECT *, row_number() OVER (PARTITION BY locus_tag, kmer ORDER BY pos) AS k,
      count(*) OVER (PARTITION BY locus_tag, kmer) AS copies FROM kmers),
  found AS (
    SELECT locus_tag, kmer, CAST(max(pos) FILTER (k = 1) AS INT) AS first_at, CAST(max(pos) FILTER (k = 2) AS INT) AS second_at,
      max(copies) AS copies FROM nth WHERE copies > 1 GROUP BY locus_tag, kmer),
  rooms AS (
    SELECT f.*, v.dna, least(length(v.dna) - second_at, greatest(12, second_at - first_at)) AS room
    FROM found f JOIN valid v USING (locus_tag))
  SELECT locus_tag, kmer, first_at, second_at, copies, CAST(list_min(list_filter(range(12, room + 1),
    lambda i: i >= room OR dna[first_at + i + 1] <> dna[second_at + i + 1])) AS INT) AS repeat_length FROM rooms""")
def direct_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return qc.repeats(_cds(spark, folder), "locus_tag", "nucleotide_seq")


_STEMS = f"""WITH {_VALID},
  heads AS (SELECT locus_tag, left(dna, 150) AS h FROM valid),
  kmers AS (
    SELECT locus_tag, pos, h[pos + 1:pos + 6] AS arm FROM (
      SELECT locus_tag, h, unnest(range(0, length(h) - 5)) AS pos FROM heads WHERE length(h) >= 15)),
  stems AS (
    SELECT a.locus_tag, a.pos AS arm_start, b.pos AS partner_start, a.arm FROM kmers a JOIN kmers b
      ON a.locus_tag = b.locus_tag AND a.arm = reverse(translate(b.arm, 'ACGT', 'TGCA')) AND b.pos >= a.pos + 9)"""


@_query(f"{_STEMS} SELECT locus_tag, CAST(arm_start AS INT) AS arm_start, CAST(partner_start AS INT) AS partner_start, arm FROM stems")
def five_prime_stems(spark: SparkSession, folder: str) -> DataFrame:
    return qc.stems(_cds(spark, folder), "locus_tag", "nucleotide_seq")


@_query(f"""{_STEMS}, spans AS (SELECT locus_tag, arm_start AS s FROM stems UNION SELECT locus_tag, partner_start FROM stems)
  SELECT DISTINCT locus_tag, CAST(i AS INT) AS codon_index FROM (
    SELECT locus_tag, unnest(range(s // 3, (s + 5) // 3 + 1)) AS i FROM spans) WHERE i > 0""")
def stem_codons(spark: SparkSession, folder: str) -> DataFrame:
    return qc.stem_codons_of(_cds(spark, folder), "locus_tag", "nucleotide_seq")


@_query(f"""SELECT target_idx, variant_number, round(gc, 9) AS overall_gc, n_homopolymers, n_repeats,
    (gc BETWEEN 0.25 AND 0.65 AND n_homopolymers = 0 AND n_repeats = 0 AND NOT strong) AS qc_pass FROM (
    SELECT target_idx, variant_number, coalesce(has_strong_structure, false) AS strong,
      CASE WHEN length(dna_sequence) < 24 THEN 0 ELSE len(list_filter(map_values(list_histogram(
        list_transform(range(1, length(dna_sequence) - 10), lambda i: upper(dna_sequence)[i:i + 11]))),
        lambda n: n > 1)) END AS n_repeats, CASE WHEN length(dna_sequence) > 0 THEN
        length(regexp_replace(upper(dna_sequence), '[^GC]', '', 'g')) / length(dna_sequence) ELSE 0.0 END AS gc,
      len(regexp_extract_all(upper(dna_sequence), '{_RUNS}')) AS n_homopolymers
    FROM variants WHERE dna_sequence IS NOT NULL)""")
def qc_summary(spark: SparkSession, folder: str) -> DataFrame:
    variants = table(spark, folder, "variants")
    keyed = variants.withColumn("key", F.struct("target_idx", "variant_number"))
    found = qc.qc_summary(keyed, "key", "dna_sequence", "has_strong_structure")
    return found.select("key.*", _r("overall_gc").alias("overall_gc"), "n_homopolymers", "n_repeats", "qc_pass")


@_query(f"""WITH p AS (
    SELECT v.target_idx, v.variant_number, regexp_replace(upper(t.protein_seq), '[*]+$', '') AS wanted,
      regexp_replace(array_to_string(list_transform(regexp_extract_all(upper(v.dna_sequence), '.{{3}}'),
        lambda c: coalesce(({_MAP})[c], 'X')), ''), '[*]$', '') AS got
    FROM variants v JOIN targets t ON t.target_idx = v.target_idx)
  SELECT target_idx, variant_number FROM p WHERE got <> wanted""")
def protein_identity_violations(spark: SparkSession, folder: str) -> DataFrame:
    proteins = table(spark, folder, "targets").select("target_idx", "protein_seq")
    joined = table(spark, folder, "variants").select("target_idx", "variant_number", "dna_sequence").join(
        proteins, "target_idx"
    )
    return design.identity_violations(joined, "dna_sequence", "protein_seq").select("target_idx", "variant_number")
