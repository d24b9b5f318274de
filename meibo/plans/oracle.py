"""The queries of ``catalogue.py`` in plain SQL, written without the methods used on Spark."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def sql(text: str, *names: str) -> None:
    for name in names:
        ORACLE_SQL[name] = text


# The address of a part.
ADDRESS = """case when p_type = 'ECONOMY' then concat('x ', p_name)
                    when p_type in ('LARGE', 'SMALL') then concat(split_part(p_name, ' ', 1), ' ', p_type)
                    else concat(p_name, ' ', p_type) end"""

# Parts as addresses, and the prefix table made from them.
PART_POSTAL = f"""
addr as (
  select p_partkey, {ADDRESS} as address,
         case when p_size <= 15 then null when p_size <= 30 then '　' else p_brand end as postal
  from part),
ref as (
  select distinct split_part(p_name, ' ', 1) as prefix, concat('W', split_part(p_name, ' ', 1)) as code from part
  union
  select distinct concat(p_name, ' ', p_type), case when p_size = 50 then 'N1' else 'N0' end from part),
codes as (
  select prefix, count(distinct code) as n, min(code) as code from ref group by prefix)"""

POSTAL_FILL = f"""
with {PART_POSTAL},
best as (
  select a.p_partkey, max(length(c.prefix)) as len
  from addr a join codes c on starts_with(a.address, c.prefix) group by a.p_partkey)
select a.p_partkey, a.address,
       case when trim(coalesce(a.postal, ''), ' 　') <> '' then a.postal
            when c.n = 1 then c.code else a.postal end as postal,
       case when trim(coalesce(a.postal, ''), ' 　') <> '' then 'kept'
            when c.n = 1 then 'filled' when c.n > 1 then 'ambiguous'
            else 'no_match' end as fill_status
from addr a
left join best b on a.p_partkey = b.p_partkey
left join codes c on length(c.prefix) = b.len and starts_with(a.address, c.prefix)"""

sql(POSTAL_FILL, "postal_fill", "postal_fill_shuffled")
sql(f"select p_partkey, address, postal from ({POSTAL_FILL})", "postal_fill_folder")

sql(
    """
with phones as (
  select c_custkey,
         case when c_acctbal >= -500 then
           concat('0', lpad(cast(c_nationkey + case c_mktsegment when 'BUILDING' then 1
                   when 'FURNITURE' then 2 when 'MACHINERY' then 50 else 0 end as varchar), 2, '0'),
                  '-', lpad(cast(c_custkey as varchar), 7, '0')) end as tel,
         concat('A', c_nationkey) as area
  from customer),
named as (
  select n_nationkey as n, r_name, concat('0', lpad(cast(n_nationkey as varchar), 2, '0')) as code
  from nation join region on n_regionkey = r_regionkey),
ref as (
  select code, concat('A', n) as area from named
  union all select code, concat('A', n - 1) from named where r_name = 'ASIA'
  union all select concat(code, '000'), concat('A', n - 1) from named where r_name = 'AFRICA'),
best as (
  select p.c_custkey, max(length(r.code)) as len
  from phones p join ref r on starts_with(replace(p.tel, '-', ''), r.code) group by p.c_custkey)
select p.c_custkey, p.tel, p.area,
       case when p.tel is null then null
            when b.len is null and regexp_matches(replace(p.tel, '-', ''), '^(0[26789]0|050|0120|0800|0570|0180|0990)') then 'no_area'
            when b.len is null then 'unknown_code'
            when exists (select 1 from ref r where length(r.code) = b.len
                         and starts_with(replace(p.tel, '-', ''), r.code) and r.area = p.area) then 'ok'
            else 'mismatch' end as verdict
from phones p left join best b on p.c_custkey = b.c_custkey""",
    "area_code_check",
    "area_code_check_shuffled",
)

JOBS = """
jobs as (
  select case when o_orderstatus <> 'F' then concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) end as name,
         case when o_orderstatus <> 'O' then concat('0', lpad(cast(o_custkey as varchar), 9, '0')) end as tel,
         case when o_totalprice > 400000 then o_orderpriority end as contact
  from orders)"""

sql(
    f"""
with {JOBS},
known as (select * from jobs where contact is not null),
pairs as (
  select concat('0', chr(1), lower(name), chr(1), tel, chr(1)) as key, contact from known
    where name is not null and tel is not null
  union all select concat('1', chr(1), tel, chr(1)), contact from known where tel is not null
  union all select concat('2', chr(1), lower(name), chr(1)), contact from known where name is not null)
select key, count(distinct contact) as n_values, min(contact) as value from pairs group by key""",
    "recruiter_index",
    "recruiter_index_kept",
)

RECRUITER_FILL = f"""
with {JOBS},
rows_ as (
  select c_custkey, c_name, concat('０-', lpad(cast(c_custkey as varchar), 9, '0')) as tel,
         case when c_mktsegment = 'BUILDING' then 'known' end as contact
  from customer),
by_both as (select name, tel, count(distinct contact) as n, min(contact) as v from jobs
            where name is not null and tel is not null and contact is not null group by name, tel),
by_tel as (select tel, count(distinct contact) as n, min(contact) as v from jobs
           where tel is not null and contact is not null group by tel),
by_name as (select name, count(distinct contact) as n, min(contact) as v from jobs
            where name is not null and contact is not null group by name),
found as (
  select r.*, coalesce(b.n, t.n, m.n) as n,
         case when b.n is not null then b.v when t.n is not null then t.v else m.v end as v
  from rows_ r
  left join by_both b on b.name = r.c_name and b.tel = replace(replace(r.tel, '０', '0'), '-', '')
  left join by_tel t on t.tel = replace(replace(r.tel, '０', '0'), '-', '')
  left join by_name m on m.name = r.c_name)
select c_custkey, c_name, tel,
       case when contact is null and n = 1 then v else contact end as contact,
       case when contact is not null then 'kept' when n = 1 then 'filled'
            when n > 1 then 'ambiguous' else 'no_match' end as fill_status
from found"""

sql(RECRUITER_FILL, "recruiter_index_fill", "recruiter_index_fill_shuffled")
sql(f"select c_custkey, c_name, tel, contact from ({RECRUITER_FILL})", "recruiter_fill_folder")

sql(
    """
select c_custkey, concat(case when c_mktsegment = 'BUILDING' then '1' else '0' end,
                         lpad(cast(c_custkey as varchar), 9, '0')) as tel,
       c_mktsegment <> 'BUILDING' and exists (
         select 1 from orders where o_custkey = c_custkey and o_orderstatus <> 'O') as seen_in_jobs
from customer""",
    "job_evidence",
    "job_evidence_shuffled",
)

SHOPS = """
shops as (select p_partkey, concat(p_brand, ' ', p_name, ' ', p_type) as name from part),
chains as (select p_name as listed from part where p_name like 'hot%'
           union select 'bolt' from part where p_name like 'hot%')"""

sql(
    f"""
with {SHOPS}
select p_partkey, name,
       case when exists (select 1 from chains where contains(name, listed)) then 'chain' end as reason
from shops""",
    "chain_exclude_contains",
    "chain_exclude_contains_joined",
    "chain_exclude_contains_shuffled",
)

sql(
    f"""
with {SHOPS}
select p_partkey, p_name from part where not exists (select 1 from chains where p_name = listed)""",
    "chain_exclude_exact",
    "chain_exclude_exact_shuffled",
)

sql(
    """
select p_partkey, p_name, 'branch' as reason from part where p_name like '_%ring'""",
    "branch_exclude",
)

sql(
    f"""
with {SHOPS}
select p_partkey, name,
       case when exists (select 1 from chains where contains(name, listed)) then 'chain'
            when name like '_%SMALL' then 'branch' else 'kept' end as reason
from shops""",
    "kept_and_excluded",
    "chain_exclude_folder",
)

sql(
    """
select c_custkey,
       case c_mktsegment
         when 'BUILDING' then case when c_name like '%99%' then 'exclude_contains'
           when c_name like '%7' then 'exclude_suffix' when c_acctbal < 0 then 'min' else 'pass' end
         when 'MACHINERY' then case when c_name like 'Customer#00000000%' then 'exclude_prefix'
           when c_acctbal > 9000 then 'max' else 'pass' end
         when 'FURNITURE' then case when c_nationkey = 3 then 'exclude_value'
           when length(c_name) > 18 then 'max_length' else 'pass' end
         else 'pass' end as outcome
from customer""",
    "customer_rules",
    "customer_rules_shuffled",
)

sql(
    """
select o_orderkey, o_orderpriority as wide, concat(o_orderstatus, ' ', o_orderstatus) as spaced,
       concat(strftime(o_orderdate, '%Y'), '00', strftime(o_orderdate, '%d')) as dashed,
       concat(substring(lpad(cast(o_custkey as varchar), 7, '0'), 1, 3), '-',
              substring(lpad(cast(o_custkey as varchar), 7, '0'), 4)) as postal
from orders""",
    "cell_fixes",
)

sql(
    """
select c_custkey, 'c_name' as column_name, c_name as before_value,
       replace(c_name, '#', '-') as after_value
from customer where c_name like '%#%'
union all
select c_custkey, 'c_mktsegment', c_mktsegment, null from customer where c_mktsegment = 'MACHINERY'""",
    "fix_log_of_cells",
)

sql(
    """
with blanked as (
  select c_custkey, case when c_acctbal <= 9800 then c_name end as c_name, c_acctbal, c_mktsegment
  from customer)
select c_custkey, 'c_name' as column_name, 'required' as check_name from blanked where c_name is null
union all select c_custkey, 'c_name', 'pattern' from blanked where c_name not like 'Customer#000000___'
union all select c_custkey, 'c_acctbal', 'range' from blanked where c_acctbal < 0
union all select c_custkey, 'c_mktsegment', 'length' from blanked where length(c_mktsegment) > 8
union all select c_custkey, 'c_mktsegment', 'value' from blanked where c_mktsegment = 'AUTOMOBILE'""",
    "row_check",
)

sql(
    """
select *, case when c_acctbal < 0 then 'in debt' else 'in credit' end as side from customer""",
    "merge_same_columns",
)
sql("select * from customer", "csv_round_trip", "csv_merge_files")

sql(
    """
select concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')) as name,
       concat('0', lpad(cast(o_custkey as varchar), 9, '0')) as tel, o_orderpriority as contact
from orders""",
    "job_csv_set",
)
sql("select distinct p_name as name from part", "name_list")
sql(
    """
select p_brand as customer, 'name' as "column",
       case when p_size > 25 then 'min' else 'exclude_suffix' end as op,
       case when p_size > 25 then cast(p_size as varchar) else p_name end as arg
from part""",
    "rules_json",
)
sql(
    "select distinct concat(p_type, p_brand) as prefix, p_name as code from part",
    "prefix_ref",
)
sql(
    """
with towns as (
  select p_type, concat(p_brand, case when p_size <= 10 or p_size between 21 and 30 then ''
                                      when p_size between 31 and 35 then concat(p_name, '一円')
                                      else p_name end) as local_, lpad(cast(p_size as varchar), 7, '0') as code
  from part)
select concat(p_type, local_) as prefix, code from towns union select local_, code from towns""",
    "postal_ref",
)
sql(
    """
select o_orderstatus, count(*) as n_rows,
       count(*) filter (where o_orderpriority like '_%LOW') as n_excluded
from orders group by o_orderstatus""",
    "folder_batch",
    "folder_stream",
)

DELIVERY = f"""
{PART_POSTAL},
chains as (select p_name as listed from part where p_name like 'hot%'
           union select 'bolt' from part where p_name like 'hot%'),
lines as (
  select cast(l_orderkey as varchar) as order_no, cast(l_linenumber as varchar) as line_no,
         l_returnflag as customer, concat(p_brand, ' ', p_name) as name,
         concat(p_brand, '　', p_name) as name_in, {ADDRESS} as address,
         case when l_discount <= 0.02 then null when l_discount <= 0.04 then ' '
              else p_brand end as postal_in,
         lpad(cast(l_suppkey + case l_linenumber when 7 then 30000000 when 6 then 50000000 else 0 end
              as varchar), 8, '0') as number_, l_linenumber, concat('A', l_linenumber) as area,
         cast(floor(l_quantity) as integer) as quantity, l_suppkey
  from lineitem join part on l_partkey = p_partkey),
listed_names as (
  select distinct name from lines where exists (select 1 from chains where contains(name, listed))),
best as (
  select a.address, max(length(c.prefix)) as len
  from (select distinct address from lines) a join codes c on starts_with(a.address, c.prefix)
  group by a.address),
fill as (
  select b.address, c.code from best b
  join codes c on length(c.prefix) = b.len and starts_with(b.address, c.prefix) where c.n = 1),
judged as (
  select l.*, concat('0', number_) as tel,
         case when customer = 'R' and l.name like '%anvil' then 'exclude_suffix'
              when customer = 'R' and quantity > 45 then 'max'
              when customer = 'A' and l.name like 'Brand#1 %' then 'exclude_prefix'
              when n.name is not null then 'chain'
              when l.name like '_%rod' then 'branch' end as reason,
         f.code
  from lines l
  left join listed_names n on n.name = l.name
  left join fill f on f.address = l.address),
done as (
  select *, coalesce(nullif(trim(postal_in), ''), code) as postal_out from judged)"""

sql(
    f"""
with {DELIVERY}
select order_no, line_no, customer, name, postal_out as postal, tel, 'delivered' as reason
from done where reason is null
union all
select order_no, line_no, customer, name_in, postal_in, concat('０', number_), reason
from done where reason is not null""",
    "delivery_job",
    "delivery_job_shuffled",
    "delivery_export",
)
sql(
    f"""
with {DELIVERY}
select order_no, line_no, name, postal_out as postal, tel from done where reason is null""",
    "delivery_export_replay",
)

sql(
    f"""
with {DELIVERY},
cells as (
  select 'name' as column_name, name_in as before_value, name as after_value from done where reason is null
  union all select 'tel', concat('０', number_), tel from done where reason is null
  union all select 'postal', postal_in, postal_out from done where reason is null)
select column_name, before_value, after_value, count(*) as n_cells
from cells where before_value is distinct from after_value group by all""",
    "delivery_job_log",
)

sql(
    f"""
with {DELIVERY},
kept as (
  select d.*, concat('A', s.s_nationkey) as real_area, l_linenumber < 6 as seen_in_jobs
  from done d join supplier s on s.s_suppkey = d.l_suppkey where reason is null),
found as (
  select 'postal' as column_name, 'required' as check_name, postal_out as value, seen_in_jobs
  from kept where postal_out is null
  union all
  select 'quantity', 'range', cast(quantity as varchar), seen_in_jobs from kept where quantity > 40
  union all
  select 'tel', case when l_linenumber < 6 then 'area_code_mismatch' else 'area_code_unknown_code' end,
         tel, seen_in_jobs
  from kept where l_linenumber = 7 or l_linenumber < 6 and real_area <> area)
select column_name, check_name, value, seen_in_jobs, count(*) as n_rows from found group by all""",
    "delivery_job_findings",
    "delivery_export_findings",
)

sql(
    """
select o_orderkey, case when o_orderpriority like '_%LOW' then 'low' end as reason,
       case when o_orderstatus = 'F' then 'a' else 'b' end as side
from orders""",
    "folder_sources",
)
sql(
    """
select o_orderkey, case when o_orderpriority like '%LOW' then 'chain' end as reason,
       substring(o_orderpriority, 1, 1) as level, 'filled' as fill_status
from orders""",
    "folder_stream_long_list",
)
sql(
    """
select case when o_orderstatus not in ('F', 'P') then cast(o_orderkey as varchar) end as key,
       case when o_orderstatus not in ('F', 'P') then o_orderstatus end as status,
       case o_orderstatus when 'F' then concat(o_orderkey, ',F,surplus')
                          when 'P' then cast(o_orderkey as varchar) end as raw
from orders""",
    "csv_odd_rows",
)
sql(
    """
with low as (select * from orders where o_orderpriority = '5-LOW')
select c_custkey,
       case when c_mktsegment <> 'BUILDING' then 'pass'
            when c_custkey in (select o_custkey from low) then 'exclude_value'
            when c_acctbal < (select max(o_orderkey % 500) from low) then 'min' else 'pass' end as outcome
from customer""",
    "customer_rules_many",
)
sql(
    """
select p_partkey, case when p_name in (select p_name from part where p_size <= 10) then 'chain' end as reason
from part""",
    "matching_spelling",
)

sql("select o_orderkey, true as same from orders", "csv_row_key")

# Block and lot numbers lie in the ranges that the sizes of a brand's parts set.
sql(
    """
with towns as (
  select p_brand, cast(regexp_extract(p_brand, '[0-9]+$') as integer) as no, cast(floor(avg(p_size)) as integer) as mid, max(p_size) as top
  from part group by p_brand),
numbers as (
  select p.*, no, mid, top, p_size // 10 as tens, p_size % 10 as ones from part p join towns using (p_brand)),
kanji as (
  select *, concat(case tens when 0 then '' when 1 then '十' else concat(substring('一二三四五', tens, 1), '十') end,
                   case ones when 0 then '' else substring('一二三四五六七八九', ones, 1) end) as read from numbers),
wide as (
  select *, translate(cast(p_size as varchar), '0123456789', '０１２３４５６７８９') as broad from kanji),
judged as (
  select p_partkey, no,
         concat(case when p_type = 'LARGE' then '' else '東京都' end, '港区大字', p_brand, '町',
           case p_type when 'ECONOMY' then concat(read, case when no % 2 = 0 then '丁目二番' else '番地の二' end)
                       when 'SMALL' then concat(broad, '－１－７') when 'PROMO' then ''
                       else concat(p_size, case when no % 2 = 0 then '丁目' else '番' end) end) as address,
         case when p_type = 'PROMO' then null
              when p_size <= mid then 1
              when no % 2 = 1 then case when p_size <= top then 2 end
              when p_size = mid + 1 or p_size between mid + 2 and top - 1 then 2 else 3 end as part
  from wide)
select p_partkey, address, case when part is null then '' else concat('9', lpad(cast(no as varchar), 5, '0'), part) end as postal,
       case when part is null then 'ambiguous' else 'filled' end as fill_status
from judged""",
    "postal_fill_ranges",
    "postal_fill_ranges_shuffled",
)

sql(
    """
with named as (
  select n_nationkey as n, r_name, concat('0', lpad(cast(n_nationkey as varchar), 2, '0')) as code
  from nation join region on n_regionkey = r_regionkey),
codes as (
  select code, n as nation from named
  union all select code, n - 1 from named where r_name = 'ASIA'
  union all select concat(code, '000'), n - 1 from named where r_name = 'AFRICA'),
ref as (
  select code, concat('NATION_', nation, ' ') as place from codes
  union all select code, 'NATION_' from codes where code = '003'),
rows_ as (
  select c_custkey,
         case when c_acctbal >= -500 then
           concat('0', lpad(cast(c_nationkey + case c_mktsegment when 'BUILDING' then 1
                   when 'FURNITURE' then 2 when 'MACHINERY' then 50 else 0 end as varchar), 2, '0'),
                  '-', lpad(cast(c_custkey as varchar), 7, '0')) end as tel,
         concat(case c_mktsegment when 'AUTOMOBILE' then concat('c/o NATION_', c_nationkey, ' ')
                when 'HOUSEHOLD' then 'NATION_1 ' else concat('NATION_', c_nationkey, ' ') end, '1-2-3') as address
  from customer),
code_of as (
  select c_custkey, max(length(code)) as len from rows_ join (select distinct code from ref) c on starts_with(replace(tel, '-', ''), code) group by c_custkey),
place_of as (
  select c_custkey, max(length(place)) as len from rows_ join (select distinct place from ref) p on starts_with(address, place) group by c_custkey)
select r.c_custkey, tel, address,
       case when tel is null then null
            when c.len is null and regexp_matches(replace(tel, '-', ''), '^(0[26789]0|050|0120|0800|0570|0180|0990)') then 'no_area'
            when c.len is null then 'unknown_code'
            when p.len is null then 'unknown_place'
            when exists (select 1 from ref where code = substring(replace(tel, '-', ''), 1, c.len) and place = substring(address, 1, p.len)) then 'ok'
            else 'mismatch' end as verdict
from rows_ r left join code_of c on c.c_custkey = r.c_custkey left join place_of p on p.c_custkey = r.c_custkey""",
    "area_code_address",
    "area_code_address_shuffled",
)

sql(
    """
with known as (
  select replace(p_name, ' ', '') as name, count(distinct contact) as n, min(contact) as contact
  from (select p_name, case when length(p_name) % 3 > 0 then concat('C', p_name) else p_type end as contact from part)
  group by 1),
rows_ as (
  select p_partkey, case when p_type = 'PROMO' then 'known' end as contact,
         case p_size % 4 when 0 then concat(p_name, '（有）')
              when 1 then concat(substring(p_name, 1, p_size % 5), 'ｚ', substring(p_name, p_size % 5 + 2))
              when 2 then concat(substring(p_name, 1, p_size % 5), substring(p_name, p_size % 5 + 2))
              else concat('qq', p_name) end as name
  from part),
asked as (
  select distinct name, replace(replace(replace(name, '（有）', ''), 'ｚ', 'z'), ' ', '') as plain from rows_),
near as (
  select a.name, count(*) filter (k.name = plain) as same, min(k.n) filter (k.name = plain) as same_n, min(k.contact) filter (k.name = plain) as same_contact,
         count(*) as names, max(k.n) as n, min(k.contact) as contact
  from asked a join known k on levenshtein(a.plain, k.name) <= 1 group by a.name),
answer as (
  select name, case when same > 0 then case when same_n = 1 then same_contact end when names = 1 and n = 1 then contact end as contact from near)
select p_partkey, r.name, coalesce(r.contact, a.contact) as contact,
       case when r.contact is not null then 'kept' when a.contact is not null then 'filled_near'
            when a.name is not null then 'ambiguous' else 'no_match' end as fill_status
from rows_ r left join answer a on a.name = r.name""",
    "recruiter_near_fill",
    "recruiter_near_fill_shuffled",
)

sql(
    """
with dear as (select * from orders where o_totalprice > 300000)
select c_custkey,
       case when c_mktsegment = 'HOUSEHOLD' and exists (
              select 1 from dear where o_orderpriority = '1-URGENT' and o_custkey = c_custkey) then 'exclude_contains'
            when c_mktsegment = 'MACHINERY' and exists (
              select 1 from dear where o_orderpriority = '2-HIGH' and o_custkey = c_custkey) then 'exclude_prefix'
            when c_mktsegment = 'FURNITURE' and exists (
              select 1 from dear where o_orderpriority = '3-MEDIUM' and o_custkey % 100000 = c_custkey % 100000) then 'exclude_suffix'
            else 'pass' end as outcome
from customer""",
    "customer_rules_many_texts",
)
