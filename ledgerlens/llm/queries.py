"""The operators as named queries over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, language, leaks, lines, nearcopies, neighbours, notices, packing, ranked, suffixes, tokens, \
    variants, wrappers

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary's file; the package with the files is installed on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_benchmark_leaks")
def op7(spark, sf_dir):
    """Words of documents inside ten-word windows of benchmark items."""
    found = leaks.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    """Documents as token ids in sequences of at most 4096."""
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary())


@query("op8_token_counts")
def op8(spark, sf_dir):
    """Bytes and tokens of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary()).drop("text_hash")


@query("op5_license_notices")
def op5(spark, sf_dir):
    """License phrases and fuzzy short notices in every document."""
    return notices.scanned(_table(spark, sf_dir, "documents")).drop("text_hash")


@query("op9_language_id")
def op9(spark, sf_dir):
    """The language of every document, learned from four fifths of those that are labelled."""
    return language.languages(_table(spark, sf_dir, "documents")).drop("text_hash")


@query("op3_block_neighbours")
def op3(spark, sf_dir):
    """The five nearest rows of every vector whose id is divisible by 50."""
    vectors = neighbours.usable(_table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors)


@query("op10_main_text")
def op10(spark, sf_dir):
    """The article of every page."""
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    """Every document without the later copies of repeated runs of lines."""
    found = lines.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_deleted", "left_text")


@query("op1_suffix_repeats")
def op1(spark, sf_dir):
    """Passages of 50 words or more that stand in several places."""
    found = suffixes.repeated(_table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "start as first_word", "stop - start as n_words", "later")


@query("op6_order_minhash")
def op6(spark, sf_dir):
    """The class of near copies that every document is in."""
    return nearcopies.classes(_table(spark, sf_dir, "documents")).drop("text_hash", "keeps")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_spelling_variants", rf"""
with crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)
             order by i) as rem from range(256) r(i)),
runs as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) run from documents),
each as (select doc_id, run, count(*) times, coalesce(cast(doc_id as varchar), '') || ':' || run as named from runs where length(run) >= 5
         group by doc_id, run),
bytes as (select *, list_prepend(4294967295, flatten(list_transform(string_split(named, ''),
          lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [195, cast(ord(c) - 64 as bigint)] end))) as b from each),
hashed as (select run, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, rem[cast(xor(c, x) & 255 as int) + 1]))) as h
           from bytes, crc),
lost as (select case when h % 97 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2)
         else run end as word, times from hashed),
words as (select word, cast(sum(times) as bigint) n from lost where length(word) >= 5 group by word having sum(times) >= 3),
parts as (select word, n, length(word) size, unnest(range(1, length(word) + 1)) as place from words),
cut as (select word, n, place, left(word, place - 1) || substr(word, place + 1) rest from parts),
pairs as (select a.word, b.word as near, b.n as near_n from cut a join words b on a.rest = b.word
          union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
          union select a.word, b.word, b.n from cut a join cut b on a.rest = b.rest and a.place = b.place and a.word <> b.word),
best as (select word, count(*) n_near, min((-near_n, near)) as most from pairs group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) n_near,
           case when -most[1] >= 2 * w.n then most[2] end as form, case when -most[1] >= 2 * w.n then -most[1] end as form_n
           from words w left join best using (word)),
followed as (with recursive f as (select word, word as step from formed union all
             select f.word, formed.form from f join formed on formed.word = f.step where formed.form is not null)
             select f.word, f.step as root from f join formed on formed.word = f.step where formed.form is null)
select word, form, root, n, n_near, form_n from formed join followed using (word)""")
def op11(spark, sf_dir):
    """Words, their near words and the forms they are variants of; the 97th part of all runs loses a character first."""
    return variants.grouped(variants.counted(_table(spark, sf_dir, "documents"), misspelt=97))


@query("op12_ranked_search", rf"""
with terms as (select doc_id, r, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
               from (select *, row_number() over () r from documents)),
asked as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
counts as (select r, doc_id, term, count(*) tf from terms group by all),
sizes as (select r, cast(sum(tf) as bigint) n from counts group by r),
table_ as (select cast(count(*) as bigint) docs, cast(sum(n) as bigint) words from sizes),
held as (select term, count(*) df from counts group by term),
impacts as (select r, doc_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
            * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) as impact
            from counts join sizes using (r) join held using (term), table_),
scores as (select item_id, r, doc_id, cast(sum(impact) as bigint) score from asked join impacts using (term) group by all having sum(impact) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last, r) as int) as rank, doc_id, score
from scores qualify rank <= 10""")
def op12(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op13_source_mix", r"""
with rows as (select row_number() over () r, doc_id, source is null as no_source, coalesce(source, '') as source,
              len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
              md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as mark from documents),
sums as (select no_source, source, cast(sum(size) as bigint) source_size from rows group by all),
turns as (select *, (row_number() over (order by no_source, source) - 1) % 3 as turn from sums),
weighed as (select *, case turn when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from turns),
fills as (select *, source_size * 2.0::double / weight as fill, sum(source_size) over () as words, sum(weight) over () as weights,
          row_number() over (order by source_size * 2.0::double / weight, no_source, source) as place from weighed),
filled as (select *, coalesce(sum(2 * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0) as full_before,
           coalesce(sum(weight) over (order by place rows between unbounded preceding and 1 preceding), 0) as weight_before from fills),
told as (select *, fill <= (words * 1.5::double - full_before) / (weights - weight_before) as "full" from filled),
goals as (select *, case when "full" then cast(2 * source_size as double) else
          (words * 1.5::double - sum(case when "full" then 2 * source_size else 0 end) over ())
          / sum(case when "full" then 0 else weight end) over () * weight end as target from told),
copies as (select rows.*, source_size, turn, target, floor(target)::bigint goal, copy, md5(cast(copy as varchar) || ':' || mark) drawn
           from rows join goals using (no_source, source), range(2) c(copy) where size > 0),
placed as (select *, copy * source_size + cast(coalesce(sum(size) over (partition by no_source, source, copy order by drawn, mark, size, r
           rows between unbounded preceding and 1 preceding), 0) as bigint) as before from copies),
taken as (select *, least(size, goal - before) as words, (before + least(size, goal - before) / 2) / goal as share
          from placed where least(size, goal - before) > 0),
due as (select *, case turn
        when 0 then case when share = 0 then 0 else least(0 + greatest(share - 0.0, 0) * 2 / (sqrt(greatest(2.25 + (share - 0.0) * -2.0, 0)) + 1.5), 1.0) end
        when 1 then share
        else case when share * 1.0 > 0.25 then least(0.5 + (share - 0.25) * 2 / (sqrt(greatest(0.25 + (share - 0.25) * 8.0, 0)) + 0.5), 1.0)
                  else share * 2 / (sqrt(0.25) + 0.5) end end as position from taken),
streamed as (select *, cast(sum(words) over (order by position, no_source, source, copy, mark, r rows between unbounded preceding and current row)
             as bigint) - words as starts_at from due),
mix as (select r, cast(sum(words) as bigint) taken, count(*) copies, min(position) first_position, min(starts_at) starts_at from streamed group by r)
select doc_id, size, source_size, target, coalesce(taken, 0) taken, coalesce(copies, 0) copies, first_position, starts_at
from rows join goals using (no_source, source) left join mix using (r)""")
def op13(spark, sf_dir):
    """How much of every document a mix of all sources takes, and when in training."""
    return curriculum.shares(_table(spark, sf_dir, "documents"))
