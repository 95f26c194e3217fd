select word, cast(row_number() over (order by word) - 1 as bigint) as vec_id from (
  select split_part(p_name, ' ', 1) as word from part union select split_part(p_name, ' ', 2) as word from part) w
