select o_orderkey as id,
  case when o_orderstatus = 'F' then 'openlibrary' else concat('part', lpad(cast(o_orderkey % 43 + 1 as varchar(2)), 2, '0')) end as source_file,
  p_name as title,
  case when o_orderkey % 17 = 0 then cast(null as varchar(3)) when o_orderkey % 19 = 0 then 'fre' else 'eng' end as lang,
  case when o_orderkey % 3 = 0 then cast(null as varchar(20)) else concat(' 89-', cast(o_orderkey % 5000 as varchar(10)), ' ') end as lccn,
  case when o_orderstatus = 'F' and o_orderkey % 4 <> 0 then concat('978', cast(o_orderkey % 7000 as varchar(10))) else cast(null as varchar(20)) end as isbn,
  case when o_orderstatus = 'F' and o_orderkey % 6 <> 0 then concat('/works/OL', cast(o_custkey as varchar(10)), 'W') else cast(null as varchar(20)) end as work_key,
  concat(
    case o_orderkey % 9 when 0 then 'Race' when 1 then 'Power' when 2 then 'Faith' when 3 then 'Gender' when 4 then 'Home'
      when 5 then 'GOLFERS' when 6 then 'Things' when 7 then 'U. S. Money' else 'Grit  and  Fil' end, ', ',
    case when o_orderkey % 8 = 0 then r_name else concat(substr(r_name, 1, 1), lower(substr(r_name, 2))) end, case when o_orderkey % 2 = 0 then ',' else '' end, ' and ',
    case when o_orderkey % 5 = 0 then 'a' when o_orderkey % 11 = 0 then 'an' else 'the' end, ' ',
    case o_orderkey % 7 when 0 then 'rise' when 1 then 'making' when 2 then 'pursuit' when 3 then 'history' when 4 then 'index' when 5 then 'invention' else 'secret life' end,
    ' of ', case when o_orderkey % 3 = 0 then 'the ' else '' end, p_name,
    case when o_orderkey % 13 = 0 then concat(' in ', concat(substr(r_name, 1, 1), lower(substr(r_name, 2)))) else '' end,
    case when o_orderkey % 4 = 0 then ' /' else '' end) as raw_subtitle
from orders
join part on p_partkey = o_orderkey % (select count(*) from part)
join region on r_regionkey = o_custkey % 5
