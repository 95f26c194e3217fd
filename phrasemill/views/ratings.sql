select event_id as id, ts as created_at, concat('subtitle ', cast(user_id as varchar(10))) as subtitle,
  case event_type when 'purchase' then 1 when 'error' then -1 when 'click' then 1 else cast(null as int) end as thumbs,
  case event_id % 3 when 0 then 'pop' when 1 then 'mainstream' else 'niche' end as system_tone,
  case event_id % 7 when 0 then 'pop' when 1 then 'pop' when 2 then 'mainstream' when 3 then 'niche' when 4 then 'niche' else cast(null as varchar(10)) end as tone_override,
  case event_id % 5 when 0 then '["funny"]' when 1 then '["grammar","boring"]' when 2 then 'not json' else '[]' end as tags,
  case event_id % 4 when 0 then 'spot_check' when 1 then 'web_user' else 'pull_ratings' end as source
from events
