select event_id, ts as timestamp, event_type as name, event_type <> 'error' as success,
  cast(event_id % 5 as int) as severity_level, case when event_id % 2 = 0 then 'Browser' else 'PC' end as client_type, value as duration, props
from events
