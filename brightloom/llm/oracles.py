"""SQL that gives the same rows as a query of this package, over whole tables."""

from __future__ import annotations

_ONCE = "select distinct on (id) * from {t} where id is not null order by id"
_PROBABILITIES = "(select unnest([0.5, 0.9, 0.95, 0.99]::double[]) as probability)"
_CELL = "cast(floor(ln(elapsed_ms) / ln(1.005::double / 0.995::double)) as integer)"
_RATIO = "(1.005::double / 0.995::double)"


def _percentiles(values: str, groups: str) -> str:
    """values: SQL of a table with the groups and a column v."""
    at = "(probability * (n_values - 1))"
    return f"""
    with v as ({values}),
    r as (select {groups}, v, row_number() over (partition by {groups} order by v) - 1 as k,
                 count(*) over (partition by {groups}) as n_values from v)
    select {groups}, probability, n_values, round(lo + (hi - lo) * (pos - floor(pos)), 6) as percentile from (
      select {groups}, probability, n_values, {at} as pos,
             max(v) filter (where k = floor{at}) as lo, max(v) filter (where k = ceil{at}) as hi
      from r cross join {_PROBABILITIES} where k = floor{at} or k = ceil{at} group by {groups}, probability, n_values)
    """


def oracle_sql() -> dict[str, str]:
    day = "cast(cast(timezone('UTC', cast(created_at as timestamptz)) as date) as varchar)"
    once = _ONCE.format
    return {
        "p6_percentiles": _percentiles(
            f"""select 'skill' as "of", skill_name as name, {day} as day, 'elapsed_ms' as metric, elapsed_ms as v from ({once(t='skill_metrics')}) where elapsed_ms > 0 and isfinite(elapsed_ms)
                union all select 'model', lower(trim(model)), {day}, metric, v from
                (select model, created_at, unnest(['elapsed_ms', 'total_tokens']) as metric,
                        unnest([elapsed_ms, cast(total_tokens as double)]) as v from ({once(t='llm_metrics')}))
                where v > 0 and isfinite(v)""",
            '"of", name, day, metric',
        ),
        "p6_skill_percentiles": _percentiles(
            f"select skill_name, {day} as day, elapsed_ms as v from ({once(t='skill_metrics')}) where elapsed_ms > 0 and isfinite(elapsed_ms)",
            "skill_name, day",
        ),
        "p6_llm_percentiles": _percentiles(
            f"""select lower(trim(model)) as model, {day} as day, metric, v from
                (select model, created_at, unnest(['elapsed_ms', 'total_tokens']) as metric,
                        unnest([elapsed_ms, cast(total_tokens as double)]) as v from ({once(t='llm_metrics')}))
                where v > 0 and isfinite(v)""",
            "model, day, metric",
        ),
        "p6_combined_percentiles": f"""
            with c as (select skill_name, {_CELL} as cell, count(*) as n from ({once(t='skill_metrics')})
                       where elapsed_ms > 0 and isfinite(elapsed_ms) group by all),
            r as (select *, sum(n) over (partition by skill_name order by cell) as upto,
                         sum(n) over (partition by skill_name) as total from c)
            select skill_name, probability, cast(total as bigint) as n_values,
                   round(pow({_RATIO}, cell) * (2 * {_RATIO} / (1 + {_RATIO})), 6) as percentile
            from r cross join {_PROBABILITIES}
            where greatest(ceil(probability * total), 1) > upto - n and greatest(ceil(probability * total), 1) <= upto""",
        "p5_rejoined": """
            select doc_id, md5(any_value(content)) as digest, true as within_limit from kb_documents where length(content) > 1000 group by doc_id""",
        "p5_found": r"""
            select doc_id, max(cast(list_max(list_transform(regexp_split_to_array(content, '[\s\p{Z}\p{P}]'),
                                                            lambda x: length(x))) > 1000 as integer)) as forced
            from kb_documents where length(content) > 1000 group by doc_id""",
    }
