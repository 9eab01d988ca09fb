"""Queries over the driver's tables, one per operator, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.functions import sequences as fn
from editloom.operators import align, amplicons, demux, genotype, report, windows
from editloom.plans import views as v
from editloom.sources import reads, sinks

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (lambda spark, sf_dir: f(lambda s: v.view(spark, sf_dir, s)), sql and v.duck(sql))
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


_LONG = "qseqid, sseqid, qstart, qend, qlen, sstart, slen, mismatch, gapopen"
_POS = "slen - sstart posdiff, case when 2 * sstart <= slen then 'front' else 'rear' end barpos"
_SIDE = lambda s: ", ".join(f"{c} {c}_{s}" for c in "qseqid qstart qend qlen sstart slen mismatch gapopen posdiff barpos".split())
_PAIRS = f"""f as (select *, {_POS} from ({v.hits('F')}) h), r as (select *, {_POS} from ({v.hits('R')}) h),
pairs as (select f.sseqid, {', '.join(f'{s}.{c} {c}_{s}' for s in 'fr' for c in 'qseqid qstart qend qlen sstart slen mismatch gapopen posdiff barpos'.split())}
 from f join r on f.sseqid = r.sseqid and f.barpos <> r.barpos)"""
_COMPLETE = "(" + " and ".join(f"mismatch_{s} + gapopen_{s} = 0 and qend_{s} - qstart_{s} + 1 = qlen_{s}" for s in "fr") + ")"
_COST = "(" + " + ".join(f"qlen_{s} - qend_{s} + qstart_{s} + mismatch_{s} + gapopen_{s}" for s in "fr") + ")"
_CLASSIFIED = f"""{_PAIRS},
seen as (select *, {_COMPLETE} cm, {_COST} cost, bool_or({_COMPLETE}) over (partition by sseqid) anycm, count(*) over (partition by sseqid) n, min({_COST}) over (partition by sseqid) least from pairs),
tied as (select *, sum(case when cost = least then 1 else 0 end) over (partition by sseqid) ties from seen),
classified as (select * exclude (cm, cost, anycm, n, least, ties), case when cm then 'complete_match' when anycm then 'excluded' when n = 1 then 'single_match' when ties > 1 then 'rest'
 when cost = least then 'partial_match' else 'excluded' end class from tied)"""
_DONE = "done as (select * from classified where class in ('complete_match', 'single_match', 'partial_match'))"
_REST = """rest as (select * exclude (class), (qstart_f = min(qstart_f) over (partition by sseqid) and qstart_r = min(qstart_r) over (partition by sseqid)) b from classified where class = 'rest'),
firsts as (select *, row_number() over (partition by sseqid order by b desc, qseqid_f, qseqid_r, sstart_f, sstart_r) n from rest),
undone as (select sseqid, """ + ", ".join(f"case when b then {c}_{s} end {c}_{s}" for s in "fr" for c in "qseqid qstart qend qlen sstart slen mismatch gapopen posdiff barpos".split()) + " from firsts where n = 1)"
_CALLED = f"""intact as ({v.WINDOWS}), aligned as ({v.ALIGNED}),
counts as (select index_pair_id, target_gene, read_seq, count(*) as "count", bool_or(read_seq = w.seq) intact from aligned join intact w on w.gene = target_gene group by index_pair_id, target_gene, read_seq),
tops as (select *, max("count") over (partition by index_pair_id, target_gene) top from counts where "count" >= 5),
ratio as (select * exclude (top), coalesce(max(case when intact then "count" end) over (partition by index_pair_id, target_gene), 0) intact_count from tops where "count" > top * 0.5),
called as (select * exclude (intact_count), case when not intact then "count" / ("count" + intact_count) end vs_intact_ratio, intact_count from ratio)"""
_LABELS = f"""{_CALLED},
kinds as (select c.*, w.seq win, case when intact then 'ref' when contains(read_seq, '-') and length(replace(read_seq, '-', '')) > length(w.seq) then 'indel' when contains(read_seq, '-') then 'del'
 when length(replace(read_seq, '-', '')) > length(w.seq) then 'ins' else 'sub' end kind from called c join intact w on w.gene = c.target_gene),
labels as (select * exclude (win), cast(list_position(['ref', 'sub', 'ins', 'del', 'indel'], kind) as int) kind_rank, case kind when 'del' then concat('del', length(read_seq) - length(replace(read_seq, '-', '')))
 when 'ins' then concat('ins', length(replace(read_seq, '-', '')) - length(win)) when 'indel' then concat('indel', length(replace(read_seq, '-', '')) - length(win), '-', length(replace(read_seq, '-', '')) - length(win)) else kind end label from kinds)"""
_BY = 'order by kind_rank, "count" desc, read_seq'
_CALLS = f"""{_LABELS},
calls as (select index_pair_id, target_gene, string_agg(label, '/' {_BY}) genotype, coalesce(string_agg(case when kind_rank > 1 then read_seq end, '/' {_BY}), '') seq,
 concat(cast(sum("count") as bigint), '(', string_agg(cast("count" as varchar), ',' {_BY}), ')') as "count" from labels group by all)"""
_SIGNIF = lambda x: f"(case when {x} = 0 then 0.0 else round({x} * pow(10.0, 2 - floor(log10(abs({x}))))) / pow(10.0, 2 - floor(log10(abs({x})))) end)"
GENES = [f"G{k}" for k in range(8)]


def _pairs(t) -> DataFrame:
    return demux.opposite_pairs(*demux.best_by_read(t(v.raw_hits("F")), t(v.raw_hits("R"))))


def _called(t) -> DataFrame:
    return genotype.edit_calls(v.aligned(t), v.windows(t))[1]


def _calls(t) -> DataFrame:
    return genotype.edit_calls(v.aligned(t), v.windows(t))[2]


# amplicons and sequences


@_query(f"select primer_id, regexp_replace(primer_id, '_[FR]$', '') gene, right(primer_id, 1) side, seq from ({v.PRIMERS}) p where regexp_matches(primer_id, '_[FR]$')")
def primer_split(t):
    return amplicons.split_primers(t(v.PRIMERS))


_SITES = "select qseqid gene, cast(sseqid as varchar(12)) chrom, sstart \"start\", sstart + 23 \"end\" from ({0}) h"
_MATED = lambda s: _SITES.format(v.hits(s)).replace("select qseqid gene", f"select replace(qseqid, '{s}', 'G') gene")


@_query(f'select gene, chrom, least(f."start", r."start", f."end", r."end") "start", greatest(f."start", r."start", f."end", r."end") "end" from ({_MATED("F")}) f join ({_MATED("R")}) r using (gene, chrom)')
def amplicon_pairing(t):
    return amplicons.pair_sites(t(_MATED("F")), t(_MATED("R")))


@_query(f'select coalesce(f.gene, r.gene) gene, coalesce(f.chrom, r.chrom) chrom from ({_MATED("F")} where sstart < 40) f full join ({_MATED("R")} where sstart < 380) r on f.gene = r.gene and f.chrom = r.chrom where f.gene is null or r.gene is null')
def amplicon_unpaired(t):
    f, r = t(_MATED("F") + " where sstart < 40"), t(_MATED("R") + " where sstart < 380")
    return amplicons.pair_sites(f, r, "full").where("start is null").select("gene", "chrom")


_SLICES = "select p_partkey id, cast(p_partkey % (select count(*) from {documents}) as bigint) doc, cast(1 + p_size as int) \"start\", cast(1 + p_size + p_partkey % 40 as int) \"end\" from {part}"


@_query(f'select s.id, s.doc chrom, s."start", s."end", substr(d.text, s."start", s."end" - s."start" + 1) seq from ({_SLICES}) s join documents d on d.doc_id = s.doc')
def interval_extract(t):
    return amplicons.cut_out(t(_SLICES).withColumnRenamed("doc", "chrom"), t("select doc_id id, text seq from {documents}"))


@_query("select doc_id id, text seq from documents where length(text) between 300 and 450")
def length_select(t):
    return reads.size_selected(t("select doc_id id, text seq from {documents}"), 300, 450)


@_query(f"with d as ({v.DNA}) select id, strpos(seq, substr(seq, 20, 12)) place, strpos(seq, reverse(translate(substr(reverse(translate(seq, 'ACGT', 'TGCA')), 30, 10), 'ACGT', 'TGCA'))) place_back from d")
def exact_locate(t):
    d = t(v.DNA).withColumn("w", F.substring("seq", 20, 12)).withColumn("m", fn.reverse_complement(F.substring(fn.reverse_complement(F.col("seq")), 30, 10)))
    return d.select("id", F.expr("cast(locate(w, seq) as bigint)").alias("place"), F.expr("cast(locate(m, seq) as bigint)").alias("place_back"))


@_query(f"""with d as ({v.DNA}), p as (select concat('G', id) gene, substr(seq, 5, 20) f, reverse(translate(substr(seq, 61, 20), 'ACGT', 'TGCA')) r, id from d),
s as (select gene, d.id chrom, strpos(d.seq, f) fs, strpos(d.seq, reverse(translate(r, 'ACGT', 'TGCA'))) rs, d.seq from d join p on contains(d.seq, f) and contains(d.seq, reverse(translate(r, 'ACGT', 'TGCA'))))
select gene, chrom, cast(least(fs, rs) as int) "start", cast(greatest(fs, rs) + 19 as int) "end", substr(seq, least(fs, rs), greatest(fs, rs) + 19 - least(fs, rs) + 1) seq from s""")
def primer_amplicons(t):
    d = t(v.DNA)
    ends = [d.select(F.concat(F.lit("G"), "id", F.lit(f"_{s}")).alias("primer_id"), x.alias("seq")) for s, x in (("F", F.substring("seq", 5, 20)), ("R", fn.reverse_complement(F.substring("seq", 61, 20))))]
    return amplicons.amplicons(ends[0].unionByName(ends[1]), d)


@_query(f"""with h as (select h.*, regexp_replace(qseqid, '_[FR]$', '') gene, right(qseqid, 1) side from ({v.PRIMER_HITS}) h join ({v.PRIMERS}) p on qseqid = primer_id where h.length = length(p.seq) and pident >= 100),
s as (select gene, side, sseqid chrom, least(sstart, send) "start", greatest(sstart, send) "end", case when sstart <= send then '+' else '-' end strand from h)
select gene, side, chrom, z."start" "start", z."end" "end", z.strand strand from (select gene, side, chrom, min({{'start': "start", 'end': "end", 'strand': strand}}) z from s group by all) x""")
def primer_hits(t):
    return amplicons.sites_of_hits(t(v.PRIMER_HITS), t(v.PRIMERS))


@_query(f"select id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from ({v.DNA}) d")
def revcomp(t):
    return t(v.DNA).select("id", fn.reverse_complement(F.col("seq")).alias("rc"))


@_query(f"select id, regexp_full_match(upper(concat(seq, case when ordinal % 3 = 0 then 'E' else '-' end)), '[ACGTRYSWKMBDHVN.+-]*') ok from ({v.DNA}) d")
def dna_check(t):
    return t(v.DNA).select("id", fn.is_dna(F.concat("seq", F.when(F.col("ordinal") % 3 == 0, "E").otherwise("-"))).alias("ok"))


# demultiplexing


@_query(f"select {_LONG} from ({v.BEST.format(v.raw_hits('F'))}) b")
def best_hsp(t):
    return demux.best_hits(t(v.raw_hits("F")))


@_query(f"select {_LONG}, {_POS} from ({v.hits('F')}) h")
def barcode_position(t):
    return demux.with_position(t(v.hits("F")))


@_query(f"with {_PAIRS} select * from pairs")
def opposite_end_pairs(t):
    return _pairs(t)


@_query(f"with {_PAIRS} select * from pairs where {_COMPLETE}")
def demux_complete(t):
    return _pairs(t).where(demux.complete_match())


@_query(f"with {_CLASSIFIED} select * from classified")
def demux_classify(t):
    return demux.classify(_pairs(t))


@_query(f"with {_PAIRS}, seen as (select *, bool_or({_COMPLETE}) over (partition by sseqid) done from pairs) select * exclude done from seen where not done")
def demux_rest_anti(t):
    return demux.without_complete(_pairs(t))


@_query(f"with {_CLASSIFIED}, {_REST} select * from undone")
def undemux_representative(t):
    return demux.undemultiplexed(demux.classify(_pairs(t)))


@_query(f"select f_id id, arg_min(f_seq, ordinal) seq, min(ordinal) ordinal from ({v.INDEX_LIST}) i group by 1")
def index_dedupe(t):
    return demux.first_indexes(t(v.INDEX_LIST), "f")


_SAMPLED = f"{_CLASSIFIED}, {_DONE}, lst as (select concat(f_id, '_', r_id) p, arg_min(pair_id, ordinal) pid from ({v.INDEX_LIST}) i group by 1), sampled as (select done.*, concat(qseqid_f, '_', qseqid_r) index_pair, pid index_pair_id from done left join lst on p = concat(qseqid_f, '_', qseqid_r))"


@_query(f"with {_SAMPLED} select * from sampled")
def sample_lookup(t):
    return demux.with_samples(demux.demultiplexed(demux.classify(_pairs(t))), t(v.INDEX_LIST))


_ALL = "qseqid qstart qend qlen sstart send slen mismatch gapopen sseq qseq posdiff barpos".split()
_EVERY = lambda s: ", ".join(f"{s}.{c} {c}_{s}" for c in _ALL)


@_query(f"""with f as (select *, {_POS} from ({v.long_hits('F')}) h), r as (select *, {_POS} from ({v.long_hits('R')}) h),
pairs as (select f.sseqid, {_EVERY('f')}, {_EVERY('r')} from f join r on f.sseqid = r.sseqid and f.barpos <> r.barpos),
complete as (select *, 'complete_match' class from pairs where {_COMPLETE}), rest1 as (select * from pairs where sseqid not in (select distinct sseqid from complete)),
alone as (select sseqid from rest1 group by sseqid having count(*) = 1), single as (select *, 'single_match' class from rest1 where sseqid in (select sseqid from alone)),
rest2 as (select *, {_COST} cost from rest1 where sseqid not in (select sseqid from alone)), least as (select sseqid, min(cost) least from rest2 group by sseqid),
best as (select sseqid, least from rest2 join least using (sseqid) where cost = least group by sseqid, least having count(*) = 1),
partial as (select rest2.* exclude cost, 'partial_match' class from rest2 join best using (sseqid) where cost = least),
done as (select * from complete union all select * from single union all select * from partial),
lst as (select concat(f_id, '_', r_id) p, arg_min(pair_id, ordinal) pid from ({v.INDEX_LIST}) i group by 1)
select done.*, concat(qseqid_f, '_', qseqid_r) index_pair, pid index_pair_id from done left join lst on p = concat(qseqid_f, '_', qseqid_r)""")
def demultiplex_list(t):
    done = demux.demultiplex(t(v.raw_hits("F")), t(v.raw_hits("R")), t(v.INDEX_LIST))[0]
    more = {c: F.expr(x) for s in "fr" for c, x in v.long_columns(s).items()}  # for the pairs that are kept
    return done.withColumns(more).select("sseqid", *(f"{c}_{s}" for s in "fr" for c in _ALL), "class", "index_pair", "index_pair_id")


# alignment windows


@_query(f"select * exclude n from (select *, row_number() over (partition by sseqid order by ordinal, qseqid) n from (select distinct qseqid, sseqid, min(qstart) qstart, max(qend) qend, ordinal, min(mismatch) mismatch, 0 gapopen from ({v.GENE_HITS}) h group by qseqid, sseqid, ordinal) d) x where n = 1")
def first_hit_per_read(t):
    one = t(v.GENE_HITS).groupBy("qseqid", "sseqid", "ordinal").agg(F.min("qstart").alias("qstart"), F.max("qend").alias("qend"), F.min("mismatch").alias("mismatch"), F.lit(0).alias("gapopen"))
    return windows.one_amplicon_per_read(one)


@_query(f'select h.*, w."start" w_start, w."end" w_end from ({v.GENE_HITS}) h join ({v.TARGETS}) w on h.qseqid = w.gene and qstart <= w."start" and qend >= w."start"')
def window_coverage(t):
    return windows.covering(t(v.GENE_HITS), t(v.TARGETS)).drop("seq")


@_query(f"select index_pair_id, target_gene, read_name, read_seq, length(read_seq) - length(replace(read_seq, '-', '')) gaps, contains(read_seq, '-') has_gap from ({v.ALIGNED}) a")
def gap_count(t):
    a = v.aligned(t)
    return a.select("*", fn.gap_count(F.col("read_seq")).cast("bigint").alias("gaps"), (F.instr("read_seq", "-") > 0).alias("has_gap"))


@_query(f"""select id, substr(s, ts, n) read_seq, substr(q, ts, n) ref_seq from (select *, case when length(m) > 0 then length(m) else length(rest) end n from (
 select *, substr(q, ts) rest, regexp_extract(substr(q, ts), '^(?:-*[^-]){{20}}.?', 0) m from (select *, st + length(substr(q, 1, st - 1)) - length(replace(substr(q, 1, st - 1), '-', '')) ts from ({v.ALIGNMENTS}) a) b) c) d""")
def gap_window(t):
    return t(v.ALIGNMENTS).select("id", fn.gap_window(F.col("q"), F.col("s"), F.col("st"), 20).alias("w")).select("id", "w.read_seq", "w.ref_seq")


@_query(f"""with h as ({v.AMPLICON_HITS}), w as ({v.TARGETS}), one as (select * from (select *, row_number() over (partition by sseqid order by ordinal, qseqid) n from h) x where n = 1),
a as (select one.*, w."start" - qstart + 1 st from one join w on w.gene = qseqid and qstart <= w."start" and qend >= w."start"),
b as (select *, st + length(substr(qseq, 1, st - 1)) - length(replace(substr(qseq, 1, st - 1), '-', '')) ts from a),
c as (select *, regexp_extract(substr(qseq, ts), '^(?:-*[^-]){{20}}.?', 0) m from b), d as (select *, case when length(m) > 0 then length(m) else length(substr(qseq, ts)) end n_cols from c)
select qseqid target_gene, sseqid read_name, substr(sseq, ts, n_cols) read_seq, substr(qseq, ts, n_cols) ref_seq, substr(sseq, ts, n_cols) in (select seq from w) intact,
 sseq full_read_seq, sstart aln_start, send aln_end from d""")
def alignment_list(t):
    first = windows.one_amplicon_per_read(t(v.AMPLICON_HITS))
    return genotype.is_intact(windows.window_patterns(first, t(v.TARGETS)), t(v.TARGETS), any_gene=True)


_LOCATED = f"select gene, concat(substr({v.bases('gene')}, 25, 7), seq, substr({v.bases('seq')}, 1, 20)) seq from ({v.WINDOWS}) w"


@_query(f'select w.gene, w.seq, cast(strpos(a.seq, w.seq) as int) "start", cast(strpos(a.seq, w.seq) + length(w.seq) - 1 as int) "end" from ({v.WINDOWS}) w join ({_LOCATED}) a using (gene) where contains(a.seq, w.seq)')
def window_locate(t):
    return windows.located(v.windows(t), t(_LOCATED))


_CHROMS = f"select concat('chr', case when p_partkey < 10 then '0' else '' end, cast(p_partkey as varchar(12))) id, {v.bases(*(f'concat({chr(39)}d{n}-{chr(39)}, {v.text("p_partkey")})' for n in (1, 2, 3)))} seq from {{part}}"
_POINTS = "select concat('G', cast(p_partkey as varchar(12))) gene, cast(p_partkey as int) chrom, cast(30 + p_partkey % 40 as int) pos from {part}"
_CUTS = "select concat('G', cast(p_partkey as varchar(12))) gene, concat('chr', case when p_partkey < 10 then '0' else '' end, cast(p_partkey as varchar(12))) chrom, cast(5 + p_partkey % 11 as int) \"start\", 90 \"end\" from {part}"


@_query(f"""select p.gene, substr(c.seq, pos - 10, 21) seq, pos - 10 - a."start" + 1 "start", pos + 10 - a."start" + 1 "end" from ({_POINTS}) p join ({_CHROMS}) c on c.id = concat('chr', case when p.chrom < 10 then '0' else '' end, cast(p.chrom as varchar)) join ({_CUTS}) a on a.gene = p.gene and a.chrom = c.id""")
def target_windows(t):
    return windows.target_windows(t(_POINTS), t(_CUTS), t(_CHROMS))


@_query(f"select a.*, exists (select 1 from ({v.WINDOWS}) w where w.gene = a.target_gene and w.seq = a.read_seq) intact from ({v.ALIGNED}) a")
def intact_own_gene(t):
    return genotype.is_intact(v.aligned(t), v.windows(t))


@_query(f"select a.*, a.read_seq in (select seq from ({v.WINDOWS}) w) intact from ({v.ALIGNED}) a")
def intact_any_gene(t):
    return genotype.is_intact(v.aligned(t), v.windows(t), any_gene=True)


@_query(f"with {_SAMPLED}, a as ({v.ALIGNED}) select a.target_gene, a.read_name, a.read_seq, i7_index, i5_index, s.index_pair_id from a left join (select distinct sseqid, qseqid_f i7_index, qseqid_r i5_index, index_pair_id from sampled) s on s.sseqid = a.read_name")
def align_fanout(t):
    done = demux.with_samples(demux.demultiplexed(demux.classify(_pairs(t))), t(v.INDEX_LIST))
    return windows.with_samples(v.aligned(t).drop("index_pair_id"), done)


# genotypes


@_query(f"with {_CALLED} select * from counts")
def pattern_counts(t):
    return genotype.pattern_counts(v.aligned(t), v.windows(t))


@_query(f'with {_CALLED} select * from counts where "count" > 4')
def min_count_filter(t):
    return genotype.frequent(genotype.pattern_counts(v.aligned(t), v.windows(t)))


@_query(f'with {_CALLED} select * exclude top from tops where "count" > top * 0.5')
def allele_top_half(t):
    return genotype.top_alleles(genotype.frequent(genotype.pattern_counts(v.aligned(t), v.windows(t))))


@_query(f"with {_CALLED} select * from called")
def intact_ratio(t):
    return _called(t)


@_query(f"with {_LABELS} select * from labels")
def genotype_labels(t):
    return genotype.labelled(_called(t), v.windows(t))


@_query(f"with {_CALLS} select * from calls")
def genotype_call(t):
    return _calls(t)


@_query(f"with {_CALLS}, long as (" + " union all ".join(f"select index_pair_id, target_gene, '{c}' data_type, cast(\"{c}\" as varchar) val from calls" for c in ("genotype", "seq", "count")) + ") select index_pair_id, data_type, " + ", ".join(f"max(case when target_gene = '{g}' then val end) {g}" for g in GENES) + " from long group by all")
def genotype_matrix(t):
    return genotype.genotype_matrix(_calls(t), GENES)


# reports


@_query(f"with {_CLASSIFIED}, {_DONE}, c as (" + " union all ".join(f"select '{s}' side, qseqid_{s} as \"key\", count(*) n, count(*) / sum(count(*)) over () p from done group by 2" for s in "fr") + f') select side, "key", n, {_SIGNIF("p")} * 100 pct from c')
def reads_per_index(t):
    return report.reads_per_index(demux.demultiplexed(demux.classify(_pairs(t))))


_LATE = "late as (select a.* from aligned a where a.read_name in (select sseqid from undone where qstart_f > 15 and qstart_r > 15))"


@_query(f"""with {_CALLED}, {_CLASSIFIED}, {_REST}, {_LATE}, a as (select target_gene gene, count(*) aligned from aligned group by 1), c as (select target_gene gene, cast(sum("count") as bigint) editcalled from called group by 1),
n as (select target_gene gene, count(*) non_indexed from late group by 1), k as (select gene, coalesce(aligned, 0) aligned, coalesce(editcalled, 0) editcalled, coalesce(non_indexed, 0) non_indexed from a full join c using (gene) full join n using (gene)),
j as (select *, aligned / sum(aligned) over () ap, case when aligned > 0 then editcalled / aligned end ep, case when aligned > 0 then non_indexed / aligned end np from k)
select gene, aligned, {_SIGNIF('ap')} * 100 aligned_pct, editcalled, case when ep is not null then {_SIGNIF('ep')} * 100 end editcalled_pct, non_indexed, case when np is not null then {_SIGNIF('np')} * 100 end non_indexed_pct from j""")
def reads_per_gene(t):
    rest = demux.undemultiplexed(demux.classify(_pairs(t)))
    return report.reads_per_gene(v.aligned(t), _called(t), report.non_indexed(v.aligned(t), rest))


@_query(f"select target_gene as \"key\", count(*) n, count(*) / sum(count(*)) over () proportion from ({v.ALIGNED}) a group by 1")
def gene_proportions(t):
    return report.counts_by(v.aligned(t), "target_gene")


@_query(f"with {_CLASSIFIED}, {_DONE} select count(distinct sseqid) n_distinct, count(sseqid) - count(distinct sseqid) n_repeated from done")
def distinct_and_dup_reads(t):
    return report.distinct_and_repeated(demux.demultiplexed(demux.classify(_pairs(t))), "sseqid")


@_query(f"with {_CLASSIFIED}, {_REST} select count(*) n, count(*) filter (qstart_f <= 15 and qstart_r <= 15) both_sides, count(*) filter (qstart_f <= 15 or qstart_r <= 15) one_side, count(*) filter (qstart_f > 15 and qstart_r > 15) no_index from undone")
def undemux_breakdown(t):
    return report.unassigned_breakdown(demux.undemultiplexed(demux.classify(_pairs(t))))


_STATS = ", ".join(f"({k}, '{label}', {c})" for k, (c, label) in enumerate(report.READ_STATS))


@_query(f"""with {_CALLED}, {_CLASSIFIED}, {_DONE}, {_REST}, u as (select count(*) n, count(*) filter (qstart_f <= 15 and qstart_r <= 15) both_sides, count(*) filter (qstart_f <= 15 or qstart_r <= 15) one_side, count(*) filter (qstart_f > 15 and qstart_r > 15) no_index from undone),
one as (select u.*, (select count(*) from orders) raw, (select count(*) from orders where o_totalprice > 1000) filtered, (select count(distinct sseqid) from done) demultiplexed, (select count(distinct read_name) from aligned) aligned, (select cast(sum("count") as bigint) from called) editcalled from u)
select x.ordinal, x.label, cast(x.n as bigint) n, case when x.ordinal > 0 then {_SIGNIF('(x.n / one.raw)')} * 100 end pct from one, lateral (values {_STATS}) x(ordinal, label, n)""")
def read_stats(t):
    classified = demux.classify(_pairs(t))
    raw = t("select o_orderkey id, o_totalprice from {orders}")
    return report.read_stats(raw, raw.where("o_totalprice > 1000"), report.assigned_of(classified), v.aligned(t), _called(t))


@_query(f"with {_CLASSIFIED}, {_REST}, aligned as ({v.ALIGNED}), {_LATE} select * from late")
def non_indexed_reads(t):
    return report.non_indexed(v.aligned(t), demux.undemultiplexed(demux.classify(_pairs(t))))


_LABELS_OF = (("", "cast(\"key\" as varchar)"), ("Aligned reads per gene", "cast(n as varchar)"), ("Proportion of aligned reads per gene", f"regexp_replace(cast(round({_SIGNIF('p')} * 100, 10) as varchar), '\\.0$', '')"))


@_query(f"with c as (select target_gene \"key\", count(*) n, count(*) / sum(count(*)) over () p, row_number() over (order by target_gene) k from ({v.ALIGNED}) a group by 1), l as ("
        + " union all ".join(f"select {k} ordinal, '{label}' label, k, {x} val from c" for k, (label, x) in enumerate(_LABELS_OF)) + ") select ordinal, label, " + ", ".join(f"max(case when k = {k} then val end) c{k}" for k in range(1, 9)) + " from l group by all")
def report_matrix(t):
    counted = report.counts_by(v.aligned(t), "target_gene").withColumn("pct", fn.percent(F.col("proportion"), F.lit(1.0)))
    return report.labelled_rows([(counted, "key", tuple((label, c) for (label, _), c in zip(report.GENE_ROWS, ("n", "pct"))))])


@_query(f"select o_orderkey, {_SIGNIF('(o_totalprice / 7.0)')} x, {_SIGNIF('(o_totalprice / 100000.0)')} * 100 pct from {{orders}}")
def significant_digits(t):
    return t("select o_orderkey, o_totalprice from {orders}").select("o_orderkey", fn.significant(F.col("o_totalprice") / 7.0).alias("x"), fn.percent(F.col("o_totalprice"), F.lit(100000.0)).alias("pct"))


# files, sets and seeds


@_query("select doc_id, lpad(cast((row_number() over (order by doc_id) - 1) // 300 + 1 as varchar), cast(length(cast(greatest(1, cast(ceil((select count(*) from documents) / 300.0) as bigint)) as varchar)) as int), '0') chunk from documents")
def chunk_assignment(t):
    d = t("select doc_id from {documents}")
    return sinks.chunk_names(d, "doc_id", d.count(), 300)


@_query(f"select distinct qseqid, sseqid from ({v.raw_hits('F')}) h")
def distinct_rows(t):
    return t(v.raw_hits("F")).select("qseqid", "sseqid").distinct()


@_query(f"select {_LONG} from ({v.hits('F')}) f union all select {_LONG} from ({v.hits('R')}) r")
def union_chunks(t):
    return t(v.hits("F")).unionByName(t(v.hits("R")))


@_query(f"with d as ({v.DNA}), k as (select distinct id, substr(seq, i, 11) w from d, (select unnest(range(1, 87)) i) r) select a.id left_id, b.id right_id, count(*) n_words from k a join k b on a.w = b.w group by all")
def kmer_seed_join(t):
    d = t(v.DNA).select("id", "seq")
    return align.shared_words(d, d, 11)


@_query()
def local_align(t):
    """The references are a piece of a sequence for every nation; sequences are aligned with all of them."""
    known = t(f"select id, substr(seq, 11, 50) seq from ({v.DNA}) d join {{nation}} on ordinal = n_nationkey + 1")
    return align.align_reads(t(v.DNA).select("id", "seq"), [(r.id, r.seq) for r in known.orderBy("id").collect()], seed=8, min_score=20)


@_query(f"select id, seq from ({v.DNA}) d")
def fasta_roundtrip(t):
    d = t(v.DNA).select("id", "seq")
    spark = d.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/editloom-fasta-{uuid.uuid4().hex}"
    sinks.write_fasta(d, path)
    return reads.read_fasta(spark, path).select("id", "seq")
