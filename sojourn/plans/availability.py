"""Registered availability queries."""

from __future__ import annotations

from sojourn.operators import availability as op
from sojourn.plans.registry import register

SLOTS = """select r.tour_id, r.tour_date, capacity, coalesce(booked, 0) booked, capacity-coalesce(booked, 0) available_slots
from (select distinct tour_id, tour_date from requests) r join tours t on t.id=r.tour_id
left join day_load d on d.tour_id=r.tour_id and d.day=r.tour_date"""

register("available_slots", lambda t: op.available_slots(t, t.requests), SLOTS)
register(
    "check_availability",
    lambda t: op.check_availability(t, t.requests),
    f"""select request_id, r.tour_id, r.tour_date, people requested, capacity, booked, available_slots,
  coalesce(people<=available_slots, false) available,
  case when capacity is null then 'Tour not found' when people>available_slots then 'Not enough slots' end reason
from requests r left join ({SLOTS}) s on s.tour_id=r.tour_id and s.tour_date=r.tour_date""",
)
register(
    "within_schedule",
    lambda t: op.within_schedule(t, t.requests),
    f"""select request_id, r.tour_id, r.tour_date, (r.tour_date between start_date and end_date) and available_slots>0 available,
  case when not r.tour_date between start_date and end_date then 'Date is outside tour schedule' end reason,
  case when r.tour_date between start_date and end_date then available_slots end available_slots
from requests r join ({SLOTS}) s on s.tour_id=r.tour_id and s.tour_date=r.tour_date join tours t on t.id=r.tour_id""",
)
register(
    "available_dates",
    lambda t: op.available_dates(t),
    """select s.id tour_id, s.d tour_date, capacity-coalesce(booked, 0) available_slots, capacity, booked_count
from (select id, capacity, booked_count, cast(unnest(generate_series(cast(start_date as timestamp), cast(end_date as timestamp), interval 1 day)) as date) d
      from tours) s left join day_load l on l.tour_id=s.id and l.day=s.d
where capacity-coalesce(booked, 0)>0""",
)
register(
    "admit_bookings",
    lambda t: op.admit_bookings(t, t.requests).select(
        "request_id", "tour_id", "tour_date", "user_id", "people", "accepted", "reason", "status", "total_price"
    ),
    f"""with recursive known as (select r.*, available_slots, coalesce(discount_price, price) unit_price
  from requests r left join ({SLOTS}) s on s.tour_id=r.tour_id and s.tour_date=r.tour_date left join tours t on t.id=r.tour_id),
q as (select request_id, tour_id, tour_date, people, available_slots seats,
  row_number() over (partition by tour_id, tour_date order by arrived_at, request_id) n
  from known where people between 1 and 20 and available_slots is not null),
fold as (select q.*, case when people<=seats then people else 0 end used, people<=seats ok from q where n=1
  union all select q.*, f.used+case when q.people+f.used<=q.seats then q.people else 0 end, q.people+f.used<=q.seats
  from fold f join q on q.tour_id=f.tour_id and q.tour_date=f.tour_date and q.n=f.n+1)
select k.request_id, k.tour_id, k.tour_date, k.user_id, k.people, coalesce(ok, false) accepted,
  case when not k.people between 1 and 20 then 'Invalid party size' when available_slots is null then 'Tour not found'
       when k.people>available_slots then 'Not enough slots' when not ok then 'Slots taken by earlier requests' end reason,
  case when ok then 'pending' end status, case when ok then cast(unit_price*k.people as decimal(18,2)) end total_price
from known k left join fold f on f.request_id=k.request_id""",
)
