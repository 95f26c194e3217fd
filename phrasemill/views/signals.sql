select p_name as filler, count(*) as freq, sum(q) as checkouts, sum(n) as editions from part
join (select l_partkey, sum(l_quantity) as q, count(*) as n from lineitem group by l_partkey) l on l_partkey = p_partkey
group by p_name
