select event_id as iteration, case event_id % 6 when 0 then 'pop_tone_blend' when 1 then 'pop_exponent' when 2 then 'sample_tone_spread'
    when 3 then 'tier_center_pop' when 4 then 'weighted_sample_spread' else 'pop_missing_default' end as param,
  round(cast(event_id * 37 % 100 as double) / 100, 2) as new_value,
  round(cast(event_id as double) / 900 + cast(event_id * 7919 % 1000 as double) / 3000, 4) as quality,
  round(cast(event_id as double) / 700 + cast(event_id * 104729 % 1000 as double) / 3000, 4) as separation
from events
