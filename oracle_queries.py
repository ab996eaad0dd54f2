"""Independent SQL for every registered query, run by DuckDB on the same parquet tables.

The SQL states each result the plain way (outer joins, IN, ordered lists) and shares
nothing with the DataFrame plans but the catalogue rules of FIXTURES.md.
"""

from __future__ import annotations

import re

from catalens.plans.kpis import KPIS

SEED = 42

# The catalogue derived from the test tables, one defining query per table.
CATALOGUE = {
    "artist": """
        select c_custkey as id, md5(concat('artist:', c_custkey)) as gid, c_name as name,
          c_name as sort_name,
          case when c_mktsegment in ('BUILDING','HOUSEHOLD','FURNITURE') then 1 else 2 end as type,
          c_nationkey as area, cast(1900 + c_custkey % 100 as int) as begin_date_year,
          cast(null as int) as end_date_year,
          case when c_custkey % 23 = 0 then 1 else 0 end as edits_pending
        from customer""",
    "artist_ipi": """
        select c_custkey as artist, lpad(cast(c_custkey*10 as string),11,'0') as ipi
        from customer where c_custkey % 3 = 1
        union all select c_custkey, lpad(cast(c_custkey*10+1 as string),11,'0')
        from customer where c_custkey % 6 = 1""",
    "artist_isni": """
        select c_custkey as artist, lpad(cast(c_custkey*10 as string),16,'0') as isni
        from customer where c_custkey % 7 = 3""",
    "url": """
        select c_custkey*4 as id, concat('https://viaf.org/viaf/',c_custkey) as url
        from customer where c_custkey % 4 = 0
        union all select c_custkey*4+1, concat('https://www.wikidata.org/wiki/Q',c_custkey)
        from customer where c_custkey % 2 = 0
        union all select c_custkey*4+2, concat('https://www.imdb.com/name/nm',c_custkey)
        from customer where c_custkey % 7 = 0
        union all select c_custkey*4+3, concat('https://example.org/a/',c_custkey)
        from customer where c_custkey % 9 = 0""",
    "l_artist_url": "select cast(floor(id/4) as bigint) as entity0, id as entity1 from url",
    "artist_credit": "select c_custkey as id, c_name as name from customer",
    "artist_credit_name": """
        select c_custkey as artist_credit, 0 as position, c_custkey as artist from customer
        union all select c_custkey, 1, c_custkey + 1 from customer where c_custkey % 8 = 0""",
    "recording": """
        select o_orderkey as id, md5(concat('recording:',o_orderkey)) as gid,
          case when o_orderkey % 60 = 3 then 'other title'
            when o_orderkey % 40 = 23 then concat(p_name,' (Live)')
            when o_orderkey % 80 = 3 then upper(p_name) else p_name end as name,
          case when o_orderkey % 12 in (2,3,6,7)
            then cast(floor(o_orderkey/4) as bigint) % 37 * 4
            else o_custkey - o_custkey % 4 end as artist_credit,
          case when o_orderkey % 11 = 0 then null
            when o_orderkey % 16 < 12 then 180000 + o_orderkey % 7 * 900
            else cast(floor(o_totalprice) as bigint) end as length,
          case when o_orderpriority='1-URGENT' then 'live' else '' end as comment,
          case when o_orderkey % 50 = 0 then 1 else 0 end as edits_pending,
          o_orderdate as last_updated
        from orders join part on p_partkey = cast(floor(o_orderkey/4) as bigint) % 50""",
    "isrc": """
        select o_orderkey as recording,
          concat('QZ', lpad(cast(cast(floor(o_orderkey/2) as bigint) as string),10,'0')) as isrc
        from orders where o_orderkey % 20 in (2,3)
        union all select o_orderkey,
          concat('QX', lpad(cast(cast(floor(o_orderkey/3) as bigint) as string),10,'0'))
        from orders where o_orderkey % 30 in (9,10,11)
        union all select o_orderkey, concat('QU', lpad(cast(o_orderkey as string),10,'0'))
        from orders where o_orderkey % 5 = 4""",
    "work": """
        select p_partkey as id, md5(concat('work:',p_partkey)) as gid, p_name as name,
          p_size as type, '' as comment,
          case when p_partkey % 40 = 0 then 1 else 0 end as edits_pending,
          timestamp '2024-01-01 00:00:00' as last_updated
        from part""",
    "iswc": """
        select p_partkey as work, concat('T', lpad(cast(p_partkey as string),9,'0')) as iswc
        from part where p_partkey % 3 = 1
        union all select p_partkey,
          concat('U', lpad(cast(cast(floor(p_partkey/2) as bigint) as string),9,'0'))
        from part where p_partkey % 10 in (4,5)""",
    "l_recording_work": """
        select distinct l_orderkey as entity0, l_partkey as entity1
        from lineitem where l_linenumber = 1 and l_partkey % 7 <> 0""",
    "release_group": """
        select s_suppkey as id, s_name as name,
          case when s_suppkey % 8 = 0 then null else s_nationkey end as type from supplier""",
    "release": """
        select p_partkey as id, md5(concat('release:',p_partkey)) as gid,
          concat(p_name,' ',p_brand) as name, p_partkey % 100 as release_group,
          case when p_size % 6 = 0 then null else 1 end as status,
          case when p_partkey % 60 = 0 then 1 else 0 end as edits_pending
        from part""",
    "medium": """
        select p_partkey*2 as id, p_partkey as release from part
        union all select p_partkey*2+1, p_partkey from part where p_partkey % 3 = 0""",
    "track": """
        select l_orderkey*1000000+l_partkey as id,
          l_partkey*2 + (case when l_partkey % 3 = 0 then l_linenumber % 2 else 0 end) as medium,
          l_orderkey as recording
        from lineitem where l_linenumber >= 6""",
}

# Named sub-results the queries below build on, in dependency order.
SHARED = {
    "srec": "select * from recording where edits_pending = 0",
    "swork": "select * from work where edits_pending = 0",
    "srel": "select * from release where edits_pending = 0",
    "person": "select * from artist where type = 1 and edits_pending = 0",
    "dup_isrc": """
        select isrc, count(distinct recording) as sharers from isrc
        where isrc is not null and recording in (select id from srec)
        group by isrc having count(distinct recording) > 1""",
    "dup_iswc": """
        select iswc, count(distinct work) as sharers from iswc
        where iswc is not null and work in (select id from swork)
        group by iswc having count(distinct work) > 1""",
    "kind_url": """
        select entity0 as artist, url from l_artist_url join url on entity1 = url.id""",
    "person_ids": """
        select p.*,
          case when id in (select artist from artist_ipi) then 1 else 0 end as ipi,
          case when id in (select artist from artist_isni) then 1 else 0 end as isni,
          case when id in (select artist from kind_url where url like '%viaf%')
            then 1 else 0 end as viaf,
          case when id in (select artist from kind_url where url like '%wikidata%')
            then 1 else 0 end as wikidata,
          case when id in (select artist from kind_url where url like '%imdb%')
            then 1 else 0 end as imdb
        from person p""",
    "released": """
        select t.recording, rel.id as release, rel.edits_pending
        from track t join medium m on t.medium = m.id join release rel on m.release = rel.id""",
    "credited": """
        select r.id as recording, n.artist from recording r
        join artist_credit c on r.artist_credit = c.id
        join artist_credit_name n on n.artist_credit = c.id""",
    "known": "select artist from artist_isni union select artist from artist_ipi",
    "rec_isrc": "select recording from isrc where isrc is not null",
    "rec_iswc": """
        select l.entity0 as recording from l_recording_work l join work w on l.entity1 = w.id
        join iswc i on i.work = w.id where i.iswc is not null""",
    "rec_known": "select recording from credited where artist in (select artist from known)",
    "work_rec": """
        select l.entity1 as work, r.id as recording
        from l_recording_work l join recording r on l.entity0 = r.id""",
    "release_rec": """
        select m.release, r.id as recording from medium m join track t on t.medium = m.id
        join recording r on t.recording = r.id""",
    "artist_flagged": """
        select p.*,
          case when id in (select artist from known) then 1 else 0 end as has_artist_id,
          case when id in (select artist from credited
            where recording in (select recording from rec_isrc)) then 1 else 0 end as has_isrc,
          case when id in (select artist from credited
            where recording in (select recording from rec_iswc)) then 1 else 0 end as has_iswc,
          case when id in (select artist from credited
            where recording in (select recording from released)) then 1 else 0 end as on_release
        from person p""",
    "work_flagged": """
        select w.*,
          case when id in (select work from iswc where iswc is not null)
            then 1 else 0 end as has_iswc,
          case when id in (select work from work_rec
            where recording in (select recording from rec_isrc)) then 1 else 0 end as has_isrc,
          case when id in (select work from work_rec
            where recording in (select recording from rec_known))
            then 1 else 0 end as has_artist_id,
          case when id in (select work from work_rec
            where recording in (select recording from released)) then 1 else 0 end as on_release
        from swork w""",
    "recording_flagged": """
        select r.*,
          case when id in (select recording from rec_isrc) then 1 else 0 end as has_isrc,
          case when id in (select recording from rec_iswc) then 1 else 0 end as has_iswc,
          case when id in (select recording from rec_known) then 1 else 0 end as has_artist_id,
          case when id in (select recording from released) then 1 else 0 end as on_release
        from srec r""",
    "release_flagged": """
        select r.*, case when g.type is not null then 1 else 0 end as has_date,
          case when r.status is not null then 1 else 0 end as has_country,
          case when r.id in (select release from release_rec
            where recording in (select recording from rec_isrc)) then 1 else 0 end as has_isrc,
          case when r.id in (select release from release_rec
            where recording in (select recording from rec_iswc)) then 1 else 0 end as has_iswc,
          case when r.id in (select release from release_rec
            where recording in (select recording from rec_known))
            then 1 else 0 end as has_artist_id
        from srel r left join release_group g on r.release_group = g.id""",
}


def _level(high: str, medium: str) -> str:
    return f"case when {high} then 'High' when {medium} then 'Medium' else 'Low' end"


# entity -> (plural, flags with their coverage columns, score, phase 1 Medium)
CONFIDENCE = {
    "artist": (
        "artists",
        {
            "has_artist_id": "artist_id_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        "3*has_artist_id + 3*has_iswc + 2*has_isrc + 2*on_release",
        "has_artist_id + has_isrc = 2 or has_iswc + on_release = 2",
    ),
    "work": (
        "works",
        {
            "has_iswc": "iswc_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        "4*has_iswc + 3*has_artist_id + 2*has_isrc + on_release",
        "has_iswc + has_isrc = 2 or has_isrc + on_release = 2",
    ),
    "recording": (
        "recordings",
        {
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        "3*has_isrc + 3*has_iswc + 3*has_artist_id + on_release",
        "has_isrc + has_iswc = 2 or has_isrc + on_release = 2",
    ),
    "release": (
        "releases",
        {
            "has_date": "date_coverage_pct",
            "has_country": "country_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
        },
        "3*has_date + 3*has_isrc + 2*has_iswc + 2*has_artist_id",
        "has_date + has_isrc = 2 or has_country + has_isrc = 2",
    ),
}

# tenths: the phase 2 score times ten, a whole number.
for _entity, (_plural, _flags, _score, _medium) in CONFIDENCE.items():
    _every = f"{' + '.join(_flags)} = {len(_flags)}"
    SHARED[f"{_entity}_scored"] = f"""
        select *, {_level(_every, _medium)} as phase1_confidence_level,
          {_level("tenths >= 8", "tenths >= 4")} as phase2_confidence_level,
          cast(tenths as double) / 10 as phase2_confidence_score
        from (select *, {_score} as tenths from {_entity}_flagged)"""

SHARED["isrc_group"] = """
    select i.isrc, count(*) as n,
      list(struct_pack(id := r.id, name := r.name, credit := c.name, len := r.length,
        note := r.comment) order by r.id) as g
    from isrc i join srec r on i.recording = r.id left join artist_credit c on c.id = r.artist_credit
    where i.isrc is not null group by i.isrc having count(*) > 1"""
SHARED["isrc_risk"] = """
    select *,
      case when n > 2 then 'Multiple Duplicates'
        when lower(g[1].name) = lower(g[2].name) then 'Exact Match'
        when contains(lower(g[1].name), lower(g[2].name))
          or contains(lower(g[2].name), lower(g[1].name)) then 'Partial Match'
        else 'Different Names' end as name_similarity,
      case when n > 2 then 'Multiple Artists'
        when lower(g[1].credit) = lower(g[2].credit) then 'Same Artist'
        when contains(lower(g[1].credit), lower(g[2].credit))
          or contains(lower(g[2].credit), lower(g[1].credit)) then 'Similar Artist'
        else 'Different Artists' end as artist_similarity,
      case when n > 2 then 'Multiple Lengths'
        when g[1].len is null or g[2].len is null then 'Unknown Length'
        when abs(g[1].len - g[2].len) <= 5000 then 'Similar Length'
        else 'Different Length' end as length_similarity,
      case when n > 2 then 50 else
        case when lower(g[1].name) = lower(g[2].name) then 40 else 0 end
        + case when lower(g[1].credit) = lower(g[2].credit) then 30 else 0 end
        + case when abs(g[1].len - g[2].len) <= 5000 then 20 else 0 end
        + case when g[1].note = g[2].note then 10 else 0 end end as score
    from isrc_group"""


def sql(body: str, derived: bool = True) -> str:
    """``body`` with the WITH clause of everything it mentions, directly or not.

    With ``derived=False`` the catalogue tables are expected to exist as they are.
    """
    definitions = {**CATALOGUE, **SHARED} if derived else SHARED
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name in definitions:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                frontier.append(definitions[name])
    ordered = [n for n in CATALOGUE if n in needed]
    pending = [n for n in SHARED if n in needed]
    while pending:
        for name in pending:
            if not any(
                re.search(rf"\b(from|join)\s+{other}\b", SHARED[name]) for other in pending
            ):
                ordered.append(name)
                pending.remove(name)
                break
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} as ({definitions[name]})" for name in ordered)
    return f"with {ctes}\n{body}"


def pct(num: str, den: str) -> str:
    """Percent, 2 decimals, half up, on whole numbers."""
    n, d = f"cast({num} as bigint)", f"cast({den} as bigint)"
    return f"case when {d} > 0 then cast((20000 * {n} + {d}) // (2 * {d}) as double) / 100 end"


def mean3(tenths: str, n: str) -> str:
    """Mean of tenths, 3 decimals, half up."""
    s, d = f"cast({tenths} as bigint)", f"cast({n} as bigint)"
    return f"case when {d} > 0 then cast((200 * {s} + {d}) // (2 * {d}) as double) / 1000 end"


def key(*columns: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} as string), '')" for c in columns)
    return f"md5(concat_ws(':', '{SEED}', {parts}))"


def big(*columns: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


SCOPE = "'Phase 1: Focus Artistes' as scope_note"


def _overview() -> str:
    rows = [
        ("Artists", "artist where type = 1"),
        ("Works", "work"),
        ("Recordings", "recording"),
        ("Releases", "release"),
    ]
    return " union all ".join(
        f"select '{label}' as entity_type, count(*) as total_count, count(gid) as with_gid, "
        f"{pct('count(gid)', 'count(*)')} as gid_coverage_pct from {source}"
        for label, source in rows
    )


def _coverage(entities: str, population: str, code: str, link_key: str) -> str:
    have = f"(select count(*) from {population} where id in (select {link_key} from {code}))"
    return f"""
        select total as total_{entities}, coded as {entities}_with_{code},
          total - coded as {entities}_without_{code}, codes as unique_{code}s,
          {pct('coded', 'total')} as {code}_coverage_pct,
          {pct('total - coded', 'total')} as missing_{code}_pct,
          shared as duplicate_{code}_count, sharing as total_duplicate_{entities},
          {pct('sharing', 'coded')} as duplicate_rate_pct, {SCOPE}
        from (select (select count(*) from {population}) as total, {have} as coded,
          (select count(distinct {code}) from {code}
            where {link_key} in (select id from {population})) as codes,
          (select count(*) from dup_{code}) as shared,
          (select cast(coalesce(sum(sharers), 0) as bigint) from dup_{code}) as sharing)"""


def _isrc_missing(n: int) -> str:
    order = key("sample_type", "recording_id", "artist", "isrc")
    return f"""
        select recording_name, artist_name, recording_gid from (
          select 'Recordings without ISRC' as sample_type, r.id as recording_id,
            r.name as recording_name, r.gid as recording_gid, a.name as artist_name,
            a.id as artist, cast(null as string) as isrc
          from srec r join credited n on n.recording = r.id join artist a on a.id = n.artist
          where a.type = 1 and r.id not in (select recording from isrc))
        order by {order}, recording_id, artist limit {n}"""


def _iswc_missing(n: int) -> str:
    order = key("sample_type", "id", "iswc")
    return f"""
        select work_name, work_type, language_code, work_gid from (
          select 'Works without ISWC' as sample_type, id, name as work_name, gid as work_gid,
            cast(type as bigint) as work_type, cast(null as bigint) as language_code,
            cast(null as string) as iswc
          from swork where id not in (select work from iswc))
        order by {order}, id limit {n}"""


def _isrc_samples() -> str:
    order = key("sample_type", "recording_id", "artist", "isrc")
    return f"""
        select sample_type, recording_id, recording_name, recording_gid, artist_name, artist_gid
        from (
          select 'Recordings without ISRC' as sample_type, r.id as recording_id,
            r.name as recording_name, r.gid as recording_gid, a.name as artist_name,
            a.gid as artist_gid, a.id as artist, cast(null as string) as isrc
          from srec r join credited n on n.recording = r.id join artist a on a.id = n.artist
          where a.type = 1 and r.id not in (select recording from isrc)
          union all
          select 'Duplicate ISRCs', r.id, r.name, r.gid, a.name, a.gid, a.id, i.isrc
          from srec r join isrc i on i.recording = r.id join credited n on n.recording = r.id
          join artist a on a.id = n.artist
          where a.type = 1 and i.isrc in (select isrc from dup_isrc))
        order by {order}, sample_type, recording_id, artist, isrc limit 20"""


def _iswc_samples() -> str:
    order = key("sample_type", "work_id", "iswc")
    return f"""
        select sample_type, work_id, work_name, work_gid, work_type, language_code
        from (
          select 'Works without ISWC' as sample_type, id as work_id, name as work_name,
            gid as work_gid, cast(type as bigint) as work_type,
            cast(null as bigint) as language_code, cast(null as string) as iswc
          from swork where id not in (select work from iswc)
          union all
          select 'Duplicate ISWCs', id, name, gid, type, null, iswc
          from swork join iswc on work = id where iswc in (select iswc from dup_iswc))
        order by {order}, sample_type, work_id, iswc limit 20"""


IDS = ("ipi", "isni", "viaf", "wikidata", "imdb")
TITLES = {"ipi": "IPI", "isni": "ISNI", "viaf": "VIAF", "wikidata": "Wikidata", "imdb": "IMDB"}


def _profile(total: str) -> str:
    with_ = ", ".join(f"sum({i}) as {i}" for i in IDS)
    every = " + ".join(IDS)
    return f"""
        select cast(total as bigint) as total_artists,
          {', '.join(f'cast({i} as bigint) as artists_with_{i}' for i in IDS)},
          {', '.join(f'cast(total - {i} as bigint) as artists_missing_{i}' for i in IDS)},
          {', '.join(f'{pct(i, "total")} as {i}_coverage_pct' for i in IDS)},
          {pct(f'({every})', '(total * 5)')} as overall_id_completeness_pct, {SCOPE}
        from (select ({total}) as total, {with_} from person_ids)"""


JOIN_ROWS = """
    select count(*) from person p left join artist_ipi a on a.artist = p.id
    left join artist_isni b on b.artist = p.id left join l_artist_url c on c.entity0 = p.id
    left join l_artist_url d on d.entity0 = p.id left join l_artist_url e on e.entity0 = p.id"""

_SCORE = " + ".join(IDS)
_STATUSES = ", ".join(
    f"case when {i} = 1 then 'Has {t}' else 'Missing {t}' end as {i}_status"
    for i, t in TITLES.items()
)


def _least_ids(n: int) -> str:
    return f"""
        select id as artist_id, name as artist_name, gid as artist_gid, sort_name,
          {big('begin_date_year', 'end_date_year', 'area')}, {_STATUSES},
          cast({_SCORE} as bigint) as id_completeness_score
        from person_ids where {_SCORE} < 5 order by {_SCORE}, {key('id')}, id limit {n}"""


def _shown(field: str) -> str:
    return f"array_to_string([coalesce(cast(x.{field} as string), '') for x in g[1:3]], '|')"


_RISK = """isrc, n as duplicate_count, name_similarity, artist_similarity, length_similarity,
    cast(score as bigint) as duplicate_risk_score,
    case when score >= 80 then 'High Risk' when score >= 50 then 'Medium Risk'
      else 'Low Risk' end as risk_level"""

RISK = f"""
    select {_RISK}, {_shown('id')} as sample_recording_ids,
      {_shown('name')} as sample_recording_names, {_shown('credit')} as sample_artist_credits,
      {_shown('len')} as sample_lengths, {SCOPE} from isrc_risk"""


def _top_risk(n: int) -> str:
    return f"""
        select isrc, duplicate_count, duplicate_risk_score, risk_level, name_similarity,
          artist_similarity, length_similarity from (select {_RISK} from isrc_risk)
        order by duplicate_risk_score desc, duplicate_count desc, isrc limit {n}"""


LISTING = """
    select i.isrc, r.id as recording_id, r.name as recording_name, r.gid as recording_gid,
      c.name as artist_credit, r.length, r.comment,
      strftime(r.last_updated, '%Y-%m-%d %H:%M:%S') as last_updated,
      count(*) over (partition by i.isrc) as group_size,
      row_number() over (partition by i.isrc order by r.id) as group_rank
    from isrc i join srec r on i.recording = r.id left join artist_credit c on c.id = r.artist_credit
    where i.isrc in (select isrc from dup_isrc) order by i.isrc, r.id limit 100"""

ON_RELEASE = f"""
    select cast(total as bigint) as total_recordings_on_releases,
      cast(linked as bigint) as recordings_with_works,
      cast(total - linked as bigint) as recordings_without_works,
      {pct('linked', 'total')} as recordings_with_works_pct,
      {pct('(total - linked)', 'total')} as recordings_without_works_pct, {SCOPE}
    from (select count(*) as total,
        count(*) filter (where id in (select entity0 from l_recording_work)) as linked
      from srec where id in (select recording from released where edits_pending = 0))
    union all select null, null, null, null, null, 'SAMPLE_DATA'"""

ON_RELEASE_SAMPLES = f"""
    select * from (select r.id as recording_id, r.name as recording_name, r.gid as recording_gid,
      c.name as artist_credit, r.length, r.comment, rel.id as release_id,
      rel.name as release_name, rel.gid as release_gid, g.name as release_group_name,
      cast(g.type as bigint) as release_group_type,
      case when l.entity0 is null then 'No Work Link' else 'Has Work Link' end as work_status,
      count(l.entity1) as work_count,
      array_to_string(list(w.name order by w.name) filter (where w.name is not null), '|')
        as associated_works
    from srec r join released t on t.recording = r.id join srel rel on rel.id = t.release
    left join l_recording_work l on l.entity0 = r.id left join work w on w.id = l.entity1
    left join artist_credit c on c.id = r.artist_credit
    left join release_group g on g.id = rel.release_group
    group by r.id, r.name, r.gid, c.name, r.length, r.comment, rel.id, rel.name, rel.gid,
      g.name, g.type, l.entity0)
    order by work_count, {key('recording_id', 'release_id')}, recording_id, release_id limit 50"""


def _works(total: str) -> str:
    return f"""
        select cast(total as bigint) as total_works,
          cast(linked as bigint) as works_with_recordings,
          cast(entities - linked as bigint) as works_without_recordings,
          {pct('linked', 'total')} as works_with_recordings_pct,
          {pct('(entities - linked)', 'total')} as works_without_recordings_pct, {SCOPE}
        from (select ({total}) as total, count(*) as entities,
          count(*) filter (where id in (select entity1 from l_recording_work)) as linked
          from swork)"""


WORK_SAMPLES = f"""
    select w.id as work_id, w.name as work_name, w.gid as work_gid,
      cast(w.type as bigint) as work_type, cast(null as bigint) as language_code, w.comment,
      i.iswc,
      case when l.entity1 is null then 'No Recording Link' else 'Has Recording Link' end
        as recording_status,
      count(l.entity0) as recording_count,
      array_to_string(list(r.name order by r.name) filter (where r.name is not null), '|')
        as associated_recordings
    from swork w left join l_recording_work l on l.entity1 = w.id
    left join recording r on r.id = l.entity0 left join iswc i on i.work = w.id
    group by w.id, w.name, w.gid, w.type, w.comment, i.iswc, l.entity1
    order by recording_count, {key('work_id', 'iswc')}, work_id, iswc limit 50"""

INCONSISTENCIES = f"""
    select inconsistency_type, n as count,
      {pct('n', 'total')} as percentage_of_inconsistencies
    from (select *, cast(sum(n) over () as bigint) as total from (
      select 'Recordings without Works' as inconsistency_type, count(*) as n
      from srec r join released t on t.recording = r.id and t.edits_pending = 0
      where r.id not in (select entity0 from l_recording_work)
      union all
      select 'Works without Recordings', count(*) from swork
      where id not in (select entity1 from l_recording_work)))"""


def _summary(entity: str) -> str:
    plural, flags, _, _ = CONFIDENCE[entity]
    levels = ("High", "Medium", "Low")
    counts = [
        f"count(*) filter (where {p}_confidence_level = '{lv}') as {p}_{lv.lower()}_count"
        for p in ("phase1", "phase2")
        for lv in levels
    ]
    pcts = [
        f"{pct(f'{p}_{lv.lower()}_count', 'total')} as {p}_{lv.lower()}_pct"
        for p in ("phase1", "phase2")
        for lv in levels
    ]
    held = {f: f"{plural}_{f.replace('has_', 'with_')}" for f in flags}
    return f"""
        select total as total_{plural}, * exclude (total, tenths), {', '.join(pcts)},
          {mean3('tenths', 'total')} as average_phase2_score,
          {', '.join(f'{pct(held[f], "total")} as {name}' for f, name in flags.items())},
          case when tenths >= 8 * total then 'High Confidence'
            when tenths >= 4 * total then 'Medium Confidence'
            else 'Low Confidence' end as overall_confidence_level,
          'Phase 1+2: Logique explicite IDs + cohérence des liens' as scope_note
        from (select count(*) as total, sum(tenths) as tenths, {', '.join(counts)},
          {', '.join(f'cast(coalesce(sum({f}), 0) as bigint) as {held[f]}' for f in flags)}
          from {entity}_scored)"""


def _confidence_samples(entity: str, columns: str) -> str:
    flags = CONFIDENCE[entity][1]
    return f"""
        select id as {entity}_id, name as {entity}_name, gid as {entity}_gid, {columns},
          {big(*flags)}, phase1_confidence_level, phase2_confidence_score,
          phase2_confidence_level, phase2_confidence_level as confidence_level,
          phase2_confidence_score as confidence_score
        from {entity}_scored s order by tenths desc, {key('id')}, id limit 50"""


def _null(*columns: str) -> str:
    return ", ".join(f"cast(null as bigint) as {c}" for c in columns)


ARTIST_SAMPLES = _confidence_samples(
    "artist", f"sort_name, {_null('begin_date', 'end_date')}, {big('area')}"
)

LEVELS = " union all ".join(
    f"""select '{entity.capitalize()}' as entity_type,
      {', '.join(f'{p}_{lv}_pct as {p}_{lv}_percentage' for p in ('phase1', 'phase2')
                 for lv in ('high', 'medium', 'low'))},
      average_phase2_score, overall_confidence_level from ({_summary(entity)})"""
    for entity in CONFIDENCE
)

PHASES = " union all ".join(
    f"""select 'Phase {i}' as phase,
      {', '.join(f'phase{i}_{lv}_{kind} as {lv}_{kind}' for kind in ('count', 'pct')
                 for lv in ('high', 'medium', 'low'))} from ({_summary('artist')})"""
    for i in (1, 2)
)


def _histogram(source: str) -> str:
    return f"""
        select case when phase2_confidence_score >= 0.8 then '0.8-1.0 (High)'
            when phase2_confidence_score >= 0.6 then '0.6-0.8'
            when phase2_confidence_score >= 0.4 then '0.4-0.6 (Medium)'
            when phase2_confidence_score >= 0.2 then '0.2-0.4' else '0.0-0.2 (Low)' end
          as score_range, count(*) as count from {source} group by 1"""


_TENTHS = "cast(round(phase2_confidence_score * 10) as bigint)"


def _cross_tab(source: str) -> str:
    return f"""
        select phase1_confidence_level, phase2_confidence_level, count(*) as count,
          {mean3(f'sum({_TENTHS})', 'count(*)')} as avg_score from {source} group by 1, 2"""


def _discrimination(source: str) -> str:
    def row(flag: str) -> str:
        def mean(value: int) -> str:
            where = f"filter (where {flag} = {value})"
            return mean3(f"coalesce(sum({_TENTHS}) {where}, 0)", f"count(*) {where}")

        return f"""select '{flag}' as criterion, cast(sum({flag}) as bigint)
            as total_with_criterion, {mean(1)} as avg_score_with,
            {mean(0)} as avg_score_without from {source}"""

    return " union all ".join(row(f) for f in CONFIDENCE["artist"][1])


_AT_LEVEL = """name as artist_name, gid as artist_gid, phase2_confidence_score,
    phase2_confidence_level, cast(has_isrc as bigint) as has_isrc,
    cast(has_iswc as bigint) as has_iswc, cast(on_release as bigint) as on_release,
    cast(has_artist_id as bigint) as has_artist_id"""


def _at_level(level: str, direction: str) -> str:
    return f"""
        select {_AT_LEVEL} from artist_scored where phase2_confidence_level = '{level}'
        order by phase2_confidence_score {direction}, {key('id')}, id limit 20"""


def _sampled_at_level(level: str, direction: str) -> str:
    return f"""
        select artist_name, artist_gid, phase2_confidence_score, phase2_confidence_level,
          has_isrc, has_iswc, on_release, has_artist_id from ({ARTIST_SAMPLES})
        where phase2_confidence_level = '{level}'
        order by phase2_confidence_score {direction}, artist_gid limit 20"""


def _checks() -> str:
    def exists(check: str, source: str) -> str:
        return f"""select '{check}' as check, case when count(*) > 0 then 'ok' else 'fail' end
            as status, cast(count(*) as double) as value from {source}"""

    rows = [
        exists("some recording has an ISRC", "isrc where isrc is not null"),
        exists("some work has an ISWC", "iswc where iswc is not null"),
        exists(
            "some artist has an ISNI or IPI",
            "(select artist from artist_isni union all select artist from artist_ipi)",
        ),
        """select 'recordings loaded', case when count(*) = 0 then 'fail'
            when count(*) < 1000000 then 'warn' else 'ok' end, count(*) from recording""",
    ]
    for entity, (plural, *_) in CONFIDENCE.items():
        label, total = entity.capitalize(), f"total_{plural}"
        summary = f"({_summary(entity)})"
        rows.append(
            f"""select '{label}: population not empty',
                case when {total} > 0 then 'ok' else 'fail' end, {total} from {summary}"""
        )
        for p in ("phase1", "phase2"):
            parts = f"{p}_high_count + {p}_medium_count + {p}_low_count"
            rows.append(
                f"""select '{label}: {p} counts sum to total',
                    case when {parts} = {total} then 'ok' else 'fail' end, {parts}
                    from {summary}"""
            )
        rows.append(
            f"""select '{label}: average score in [0, 1]',
                case when average_phase2_score between 0 and 1 then 'ok' else 'fail' end,
                average_phase2_score from {summary}"""
        )
    return " union all ".join(rows)


def _risk_pivot() -> str:
    shorts = {
        "Same Artist": "same_artist",
        "Similar Artist": "similar_artist",
        "Different Artists": "different_artists",
        "Multiple Artists": "multiple_artists",
    }
    cells = []
    for label, short in shorts.items():
        where = f"filter (where artist_similarity = '{label}')"
        cells.append(f"count(*) {where} as count_{short}")
        mean = pct(f"coalesce(sum(duplicate_risk_score) {where}, 0)", f"(100 * count(*) {where})")
        cells.append(f"{mean} as avg_risk_{short}")
    return f"""
        select risk_level, name_similarity, {', '.join(cells)}
        from (select {_RISK} from isrc_risk) group by 1, 2"""


def _id_pivot(source: str) -> str:
    return f"""
        select ipi_status, isni_status, count(*) as artist_count,
          {pct('sum(id_completeness_score)', '(100 * count(*))')} as avg_completeness
        from {source} group by 1, 2"""


_ALL_GAPS = f"""(select {_STATUSES}, {_SCORE} as id_completeness_score
    from person_ids where {_SCORE} < 5)"""

SAMPLE_SIZES = f"""
    select 'ISRC Samples' as sample_type, count(*) as sample_count from ({_isrc_samples()})
    union all select 'Artist Samples', count(*) from ({ARTIST_SAMPLES})
    union all select 'Duplicate ISRC Samples', count(*) from ({LISTING})
    union all select 'Missing IDs Samples', count(*) from ({_least_ids(50)})"""

KPI_OVERVIEW = f"""
    select 'ISRC Coverage' as kpi_name, isrc_coverage_pct as coverage_percentage,
      duplicate_rate_pct as duplicate_percentage, total_recordings as total,
      recordings_with_isrc as covered
    from ({_coverage('recordings', 'srec', 'isrc', 'recording')})
    union all select 'ISWC Coverage', iswc_coverage_pct, duplicate_rate_pct, total_works,
      works_with_iswc from ({_coverage('works', 'swork', 'iswc', 'work')})
    union all select 'Artist ID Completeness', overall_id_completeness_pct, 0, total_artists,
      artists_with_ipi + artists_with_isni from ({_profile(JOIN_ROWS)})"""

BODIES = {
    "stats_overview": _overview(),
    "kpi_isrc_coverage": _coverage("recordings", "srec", "isrc", "recording"),
    "kpi_isrc_coverage_samples": _isrc_samples(),
    "kpi_iswc_coverage": _coverage("works", "swork", "iswc", "work"),
    "kpi_iswc_coverage_samples": _iswc_samples(),
    "kpi_iswc_detailed": f"""
        select w.id as work_id, w.name as work_name, w.gid as work_gid, i.iswc,
          cast(w.type as bigint) as work_type, {_null('language_code')}, w.comment,
          case when i.work is null then 'Missing ISWC'
            when i.iswc in (select iswc from dup_iswc) then 'Duplicate ISWC'
            else 'Unique ISWC' end as iswc_status,
          cast(w.edits_pending as bigint) as edits_pending,
          strftime(w.last_updated, '%Y-%m-%d %H:%M:%S') as last_updated
        from swork w left join iswc i on i.work = w.id""",
    "party_missing_ids_artist": _profile(JOIN_ROWS),
    "party_missing_ids_artist_distinct": _profile("select count(*) from person"),
    "party_missing_ids_artist_samples": _least_ids(50),
    "dup_isrc_candidates": RISK,
    "dup_isrc_candidates_samples": LISTING,
    "rec_on_release_without_work": ON_RELEASE,
    "rec_on_release_without_work_samples": ON_RELEASE_SAMPLES,
    "work_without_recording": _works(
        "select count(*) from swork w left join l_recording_work l on l.entity1 = w.id"
    ),
    "work_without_recording_distinct": _works("select count(*) from swork"),
    "work_without_recording_samples": WORK_SAMPLES,
    "work_recording_inconsistencies": INCONSISTENCIES,
    "work_recording_inconsistencies_distinct": INCONSISTENCIES.replace(
        "'Recordings without Works' as inconsistency_type, count(*) as n",
        "'Recordings without Works' as inconsistency_type, count(distinct r.id) as n",
    ),
    "confidence_artist": _summary("artist"),
    "confidence_artist_samples": ARTIST_SAMPLES,
    "confidence_work": _summary("work"),
    "confidence_work_samples": _confidence_samples(
        "work",
        f"cast(type as bigint) as work_type, {_null('language_code')}, "
        "(select min(i.iswc) from iswc i where i.work = s.id) as iswc",
    ),
    "confidence_recording": _summary("recording"),
    "confidence_recording_samples": _confidence_samples(
        "recording", "length, (select min(i.isrc) from isrc i where i.recording = s.id) as isrc"
    ),
    "confidence_release": _summary("release"),
    "confidence_release_samples": _confidence_samples(
        "release", _null("date_year", "date_month", "date_day", "country")
    ),
    "random_sample": f"""
        select concat('{{"id":', id, ',"gid":"', gid, '","name":"', name, '","sort_name":"',
          sort_name, '","type":', type, ',"area":', area, ',"begin_date_year":',
          begin_date_year, ',"end_date_year":', coalesce(cast(end_date_year as string), 'null'),
          ',"edits_pending":', edits_pending, '}}') as sample_data
        from artist order by {key('id')}, id limit 10""",
    "metadata_upsert": """
        select key, value, cast(updated_at as bigint) as updated_at from (
          select concat('artist:', id) as key, name as value, 1 as updated_at from artist
          where id not in (select artist from known)
          union all
          select concat('artist:', artist), concat('known:', count(*)), 2
          from (select artist from artist_isni union all select artist from artist_ipi)
          group by artist)""",
    "stored_upsert": """
        select concat('artist:', a.id) as key,
          case when k.artist is null then a.name else concat('known:', k.n) end as value,
          cast(case when k.artist is null then 1 else 2 end as bigint) as updated_at
        from artist a left join (
          select artist, count(*) as n
          from (select artist from artist_isni union all select artist from artist_ipi) group by artist) k on k.artist = a.id
        union all select concat('work:', id), name, 3 from work""",
    "stored_upsert_versions": """
        select cast(version as bigint) as version, cast(updated_at as bigint) as updated_at, entries
        from (
          select 1 as version, 1 as updated_at, (select count(*) from artist) as entries
          union all select v, 1, (select count(*) from artist where id not in (select artist from known))
          from (select unnest([2, 3]) as v)
          union all select v, 2, (select count(distinct artist) from known) from (select unnest([2, 3]) as v)
          union all select 3, 3, (select count(*) from work))
        where entries > 0""",
    "export_kpis": f"""
        select f.format, x.isrc, x.duplicate_count, x.risk_level, x.sample_recording_names
        from (select isrc, duplicate_count, risk_level, sample_recording_names from ({RISK})) x
        cross join (select unnest(['parquet', 'csv', 'json']) as format) f""",
    "export_in_order": """
        select id, name, sort_name, row_number() over (order by name desc nulls last, id) as place from artist""",
    "kpi_overview_report": KPI_OVERVIEW,
    "top_5_duplicate_isrcs": _top_risk(5),
    "top_20_duplicate_isrcs": _top_risk(20),
    "top_5_artists_with_least_ids": "select artist_name, artist_gid, ipi_status, isni_status, "
    f"id_completeness_score from ({_least_ids(5)})",
    "top_50_artists_with_least_ids": "select artist_name, artist_gid, ipi_status, isni_status, "
    f"id_completeness_score from ({_least_ids(50)})",
    "confidence_levels_report": LEVELS,
    "phase_comparison": PHASES,
    "score_histogram": _histogram("artist_scored"),
    "score_histogram_samples": _histogram(f"({ARTIST_SAMPLES})"),
    "level_cross_tab": _cross_tab("artist_scored"),
    "level_cross_tab_samples": _cross_tab(f"({ARTIST_SAMPLES})"),
    "flag_discrimination": _discrimination("artist_scored"),
    "flag_discrimination_samples": _discrimination(f"({ARTIST_SAMPLES})"),
    "inconsistency_list": INCONSISTENCIES,
    "recordings_without_isrc_list": _isrc_missing(20),
    "works_without_iswc_list": _iswc_missing(20),
    "recordings_without_isrc_sampled": f"""
        select recording_name, artist_name, recording_gid from ({_isrc_samples()})
        where sample_type = 'Recordings without ISRC'
        order by recording_gid, artist_gid limit 5""",
    "works_without_iswc_sampled": f"""
        select work_name, work_type, language_code, work_gid from ({_iswc_samples()})
        where sample_type = 'Works without ISWC' order by work_gid limit 5""",
    "low_confidence_artists": _at_level("Low", "asc"),
    "high_confidence_artists": _at_level("High", "desc"),
    "low_confidence_artists_sampled": _sampled_at_level("Low", "asc"),
    "high_confidence_artists_sampled": _sampled_at_level("High", "desc"),
    "sample_sizes": SAMPLE_SIZES,
    "table_row_counts": " union all ".join(
        f"select '{t}' as table_name, count(*) as row_count from {t}" for t in CATALOGUE
    ),
    "data_checks": _checks(),
    "duplicate_risk_pivot": _risk_pivot(),
    "artist_identifier_pivot": _id_pivot(_ALL_GAPS),
    "artist_identifier_pivot_samples": _id_pivot(f"({_least_ids(50)})"),
    "confidence_pivot": f"""
        select entity_type, overall_confidence_level, avg(average_phase2_score) as avg_score,
          avg(phase1_high_percentage) as avg_phase1_high_pct from ({LEVELS}) group by 1, 2""",
}

# Key column -> the table whose ids it holds.
KEY_COLUMNS = {
    **{f"{t}.id": t for t in ("artist", "url", "artist_credit", "recording", "work", "release_group", "release", "medium", "track")},
    "artist_ipi.artist": "artist", "artist_isni.artist": "artist", "l_artist_url.entity0": "artist", "l_artist_url.entity1": "url",
    "artist_credit_name.artist_credit": "artist_credit", "artist_credit_name.artist": "artist", "recording.artist_credit": "artist_credit",
    "isrc.recording": "recording", "iswc.work": "work", "l_recording_work.entity0": "recording", "l_recording_work.entity1": "work",
    "release.release_group": "release_group", "medium.release": "release", "track.medium": "medium", "track.recording": "recording",
}


def _key_report(column: str, target: str) -> str:
    table, name = column.split(".")
    repeated = f"count({name}) - count(distinct {name})" if column == f"{target}.id" else "0"
    return f"""
        select '{table}' as table_name, '{name}' as column_name, '{target}' as refers_to, count(*) as row_count,
          count(*) - count({name}) as null_rows, count(distinct {name}) as distinct_ids,
          cast({repeated} as bigint) as repeated_rows,
          count(distinct case when {name} not in (select id from {target} where id is not null) then {name} end) as missing_ids
        from {table} having count(*) > 0"""


def _key_violations(column: str, target: str) -> str:
    table, name = column.split(".")
    head = f"select '{table}' as table_name, '{name}' as column_name"
    if column == f"{target}.id":
        return f"""
        {head}, 'repeated id' as problem, id, count(*) as rows from {table} where id is not null group by id having count(*) > 1
        union all {head}, 'null id', null, count(*) from {table} where id is null having count(*) > 0"""
    return f"""
        {head}, 'missing id' as problem, {name} as id, cast(null as bigint) as rows from {table}
        where {name} is not null and {name} not in (select id from {target} where id is not null) group by {name}"""


BODIES["stored_confidence"] = " union all ".join(
    f"select '{entity}' as entity, total_{entity}s as total, phase1_high_count, phase1_medium_count, phase1_low_count, "
    f"phase2_high_count, phase2_medium_count, phase2_low_count, average_phase2_score from ({_summary(entity)})"
    for entity in ("artist", "work", "recording", "release")
)
# Figures kept load by load are those of the whole.
BODIES |= {
    "incremental_stats_overview": BODIES["stats_overview"],
    "incremental_isrc_coverage": BODIES["kpi_isrc_coverage"],
    "incremental_iswc_coverage": BODIES["kpi_iswc_coverage"],
    "incremental_missing_ids_artist": BODIES["party_missing_ids_artist_distinct"],
    "incremental_random_sample": BODIES["random_sample"],
    "incremental_row_counts": BODIES["table_row_counts"],
    "incremental_load_checks": f"""
        select * from ({BODIES["data_checks"]}) where "check" like 'some %' or "check" = 'recordings loaded'""",
}


def _name_pages(key: str, rows: str) -> str:
    return f"""
        select {key}, cast((place - 1) // 20 + 1 as bigint) as page, array_to_string(list(name order by place), '|') as names
        from (select {key}, name, row_number() over (partition by {key} order by name) as place from ({rows}) where name is not null)
        group by {key}, (place - 1) // 20"""


BODIES["work_recording_names"] = _name_pages(
    "work_id",
    "select l.entity1 as work_id, r.name from l_recording_work l join recording r on r.id = l.entity0 "
    "join work w on w.id = l.entity1 where w.edits_pending = 0",
)
BODIES["credit_recording_names"] = _name_pages(
    "artist_credit", "select artist_credit, name from recording where edits_pending = 0 and artist_credit is not null"
)
BODIES["catalogue_keys"] = " union all ".join(f"select * from ({_key_report(c, t)})" for c, t in KEY_COLUMNS.items())
BODIES["key_violations"] = " union all ".join(f"select * from ({_key_violations(c, t)})" for c, t in KEY_COLUMNS.items())

BODIES["published_views"] = " union all ".join(
    f"select '{name}' as view_name, '{kpi.description}' as description, "
    f"(select count(*) from ({BODIES[name]})) as row_count"
    for name, kpi in KPIS.items()
)

ORACLE = {name: sql(body) for name, body in BODIES.items()}
