"""The sequence similarity in the oracle's dialect.

The ratio of two strings is twice the characters in their matching blocks over both lengths.  Blocks
are found by a recursive query: the longest common run of a region (ties: earliest in the first
string, then in the second) is one, and the regions before and after it are looked at in turn.  In a
second string of ``FREQUENT_FROM`` characters or more, characters that make up over a hundredth of it
start no run, though a run may grow over them, and a region without another start begins with the
run of its first characters.
"""

from __future__ import annotations

#: Fixed value: length of a second string from which its frequent characters are set aside.
FREQUENT_FROM = 200


def ratio_ctes(pairs: str, p: str = "") -> str:
    """CTEs (of a ``with recursive``) that end in ``ratios(a, b, ratio)``, one row for each distinct
    pair of non-empty strings of the query ``pairs`` (``a, b``).  Their names start with ``p``."""
    return f"""
{p}numbered as materialized (
  select a, b, row_number() over (order by a, b) as pair from (select distinct a, b from ({pairs}) where a <> '' and b <> '')
), {p}firsts as (
  select pair, i, a[i] as c from {p}numbered, unnest(range(1, length(a) + 1)) as u(i)
), {p}seconds as (
  select pair, j, b[j] as c from {p}numbered, unnest(range(1, length(b) + 1)) as u(j)
), {p}frequent as (
  select pair, c from {p}seconds join {p}numbered using (pair) where length(b) >= {FREQUENT_FROM}
  group by pair, c, length(b) having count(*) > length(b) // 100 + 1
), {p}met as (
  select pair, i, j, {p}frequent.c is not null as common
  from {p}firsts join {p}seconds using (pair, c) left join {p}frequent using (pair, c)
), {p}whole_runs as (
  select *, j - row_number() over (partition by pair, i - j order by j) as run from {p}met
), {p}part_runs as (
  select pair, i, j, common, min(j) over w as whole_from, max(j) over w as whole_to,
    j - row_number() over (partition by pair, i - j, run, common order by j) as part
  from {p}whole_runs window w as (partition by pair, i - j, run)
), {p}seeds as materialized (
  select pair, min(i) as i, min(j) as j, count(*) as size, min(j) - min(whole_from) as back, max(whole_to) - max(j) as forth
  from {p}part_runs where not common group by pair, i - j, whole_from, part
  union all select pair, i, j, 0, 0, whole_to - j + 1 from {p}part_runs where common
), {p}blocks(pair, alo, ahi, blo, bhi, found) as (
  select pair, 1, length(a) + 1, 1, length(b) + 1, null::struct(i bigint, j bigint, size bigint) from {p}numbered
  union all
  select pair, lo.a, hi.a, lo.b, hi.b, case when side = 0 then best end
  from (
    select pair, alo, ahi, blo, bhi, arg_max(
      {{'i': i + cut - least(back + cut, i + cut - alo, j + cut - blo), 'j': j + cut - least(back + cut, i + cut - alo, j + cut - blo),
        'size': clipped + least(back + cut, i + cut - alo, j + cut - blo) + least(size - cut - clipped + forth, ahi - i - cut - clipped, bhi - j - cut - clipped)}},
      {{'size': clipped, 'i': -(i + cut), 'j': -(j + cut)}}) as best
    from (
      select *, least(i + size, ahi, i - j + bhi) - (i + cut) as clipped
      from (select {p}blocks.*, i, j, size, back, forth, greatest(0, alo - i, blo - j) as cut from {p}blocks join {p}seeds using (pair) where {p}blocks.found is null)
    ) where clipped > 0 or (size = 0 and i = alo and j = blo) group by pair, alo, ahi, blo, bhi
  ), unnest([0, 1, 2]) as s(side),
  lateral (select case side when 1 then alo when 2 then best.i + best.size else 0 end as a, case side when 1 then blo when 2 then best.j + best.size else 0 end as b) as lo,
  lateral (select case side when 1 then best.i when 2 then ahi else 0 end as a, case side when 1 then best.j when 2 then bhi else 0 end as b) as hi
  where side = 0 or (lo.a < hi.a and lo.b < hi.b)
), {p}ratios as materialized (
  select a, b, 2.0::double * coalesce(total, 0) / (length(a) + length(b)) as ratio
  from {p}numbered left join (select pair, sum(found.size)::bigint as total from {p}blocks where found is not null group by pair) using (pair)
)"""


def best_similarity_ctes(pairs: str) -> str:
    """CTEs that end in ``similarities(needle, hay, score)``: the highest ratio of each distinct
    ``needle`` of ``pairs`` against its ``hay`` and that text's runs of as many words."""
    whole = "select needle as a, hay as b from asked"
    return f"""
asked as materialized (
  select distinct needle, hay from ({pairs}) where needle <> '' and hay <> ''
), windows as materialized (
  select distinct needle, hay, array_to_string(words[k:k + n - 1], ' ') as part
  from (select needle, hay, string_split(hay, ' ') as words, len(string_split(needle, ' ')) as n from asked), unnest(range(1, len(words) - n + 2)) as u(k)
  where len(words) > n
), {ratio_ctes(f"{whole} union all select needle, part from windows")}, similarities as materialized (
  select needle, hay, max(ratio) as score
  from (select needle, hay, hay as part from asked union all select * from windows) join ratios on ratios.a = needle and ratios.b = part
  group by needle, hay
)"""


def best_window_ctes(rows: str, fold) -> str:
    """CTEs that end in ``closest(id, run, score)`` for ``rows`` (``id, needle, text``): the run of as
    many words as the needle has, or of one more, whose comparison form has the highest ratio (ties:
    the shorter run, then the earlier one).  ``fold`` gives the comparison form of an expression."""
    return f"""
given as materialized (
  select id, needle, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as words, len(string_split(needle, ' ')) as n from ({rows})
), pieces as materialized (
  select needle, words, n, row_number() over () as piece from (select distinct needle, words, n from given where needle <> '')
), spans as materialized (
  select piece, needle, size, k, array_to_string(words[k:k + size - 1], ' ') as run
  from pieces, unnest(list_distinct([least(n, len(words)), least(n + 1, len(words))])) as s(size), unnest(range(1, len(words) - size + 2)) as u(k)
), folded as materialized (
  select run, {fold('run')} as form from (select distinct run from spans)
), bounded as materialized (
  -- No ratio exceeds what the letters in common allow, whatever their order.
  select needle, form, 2.0 * list_sum(list_transform(list_distinct(string_split(needle, '')),
    lambda c: least(length(needle) - length(replace(needle, c, '')), length(form) - length(replace(form, c, ''))))) / (length(needle) + length(form)) as bound
  from (select distinct needle, form from spans join folded using (run)) where form <> ''
), rated as materialized (
  select piece, needle, size, k, run, form, bound from spans join folded using (run) left join bounded using (needle, form)
), {ratio_ctes("select needle as a, form as b from rated qualify row_number() over (partition by piece order by bound desc nulls last) <= 4", "top_")}, floors as materialized (
  select piece, max(ratio) as least_score from rated join top_ratios on a = needle and b = form group by piece
), {ratio_ctes("select needle as a, form as b from rated join floors using (piece) where bound >= least_score - 1e-9")}, best_of as materialized (
  select piece, arg_max(run, {{'r': coalesce(ratio, 0), 's': -size, 'k': -k}}) as run, max(coalesce(ratio, 0)) as score
  from rated left join ratios on ratios.a = needle and ratios.b = form group by piece
), closest as materialized (
  select id, run, score from given left join (select needle, words, run, score from pieces join best_of using (piece)) best
    on best.needle = given.needle and best.words = given.words
)"""
