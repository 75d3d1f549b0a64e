"""SQL counterparts of the swing setups, trade labels and the choice of trades."""

from .bar_windows import TR
from .views import CALM, MARKET, W, over


def r(x: str, digits: int) -> str:
    k = 10**digits
    return f"(floor(({x}) * {k} + 0.5) / {k})"


REGIME = f"""{MARKET}, mk AS (SELECT *, row_number() OVER (ORDER BY trading_date) AS n, avg(close) OVER (ORDER BY trading_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m50,
  avg(close) OVER (ORDER BY trading_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m200 FROM market),
 regimes AS (SELECT trading_date, CASE WHEN n < 50 THEN 'BULL_MOMENTUM' WHEN close > m50 AND m50 > CASE WHEN n >= 200 THEN m200 ELSE m50 END THEN 'BULL_MOMENTUM'
  WHEN close > CASE WHEN n >= 200 THEN m200 ELSE m50 END THEN 'BULL_CORRECTION' ELSE 'BEAR_DEFENSIVE' END AS regime FROM mk)"""

IND = f"""w0 AS (SELECT *, row_number() OVER ({W}) AS rn, avg(true_range) OVER {over(10)} AS atr10, avg(true_range) OVER {over(30)} AS atr30, avg(close) OVER {over(50)} AS a50, avg(close) OVER {over(150)} AS a150,
  avg(close) OVER {over(200)} AS a200, max(close) OVER {over(250)} AS hi, min(close) OVER {over(250)} AS lo, avg(volume) OVER {over(5)} AS vol5, avg(volume) OVER {over(40)} AS vol40,
  {', '.join(f"max(high) OVER {over(k)} AS high{k}" for k in (3, 8, 20, 30))}, {', '.join(f"min(low) OVER {over(k)} AS low{k}" for k in (5, 8, 20, 30))},
  list(volume) OVER {over(19)} AS vols, list(close < pc) OVER {over(19)} AS downs, sum(volume) FILTER (close >= pc) OVER {over(19)} AS up_volume, sum(volume) FILTER (close < pc) OVER {over(19)} AS down_volume,
  list({{'h': high, 'l': low, 'c': close}}) OVER {over(3)} AS recent FROM ranged),
 w1 AS (SELECT *, CASE WHEN rn >= 50 THEN a50 END AS s50, CASE WHEN rn >= 150 THEN a150 END AS s150, CASE WHEN rn >= 200 THEN a200 END AS s200 FROM w0),
 w2 AS (SELECT *, lag(s200, 20) OVER ({W}) AS before, len(list_filter(list_zip(vols, downs), lambda z: z[2] AND z[1] > 1.3 * vol40)) AS dist_days FROM w1),
 w3 AS (SELECT w2.*, regime, coalesce(atr10, close * 0.02) AS atr, coalesce({r('(close - s50) / s50 * 100', 1)}, 0) AS d50, {r('(close - hi) / hi * 100', 1)} AS dh, {r('hi', 2)} AS hi2,
  coalesce({r('atr10 / CASE WHEN atr30 > 0 THEN atr30 END', 2)}, 1) AS squeeze, coalesce({r('vol5 / CASE WHEN vol40 > 0 THEN vol40 END', 2)}, 1) AS dry,
  (close - low30) / greatest(0.1, high30 - low30) AS base_pos, low5 >= low30 * 0.985 AS holding,
  ((CASE WHEN s200 IS NOT NULL THEN close > s150 AND close > s200 ELSE coalesce(close > s50, false) END)::INT + (s200 IS NULL OR s150 > s200)::INT
  + (CASE WHEN rn >= 220 THEN s200 > before WHEN s200 IS NOT NULL THEN close > s200 ELSE false END)::INT + (CASE WHEN s200 IS NOT NULL THEN s50 > s150 AND s50 > s200 ELSE coalesce(close > s50, false) END)::INT
  + coalesce(close > s50, true)::INT + ((close - lo) / lo * 100 >= 25)::INT + ((close - hi) / hi * 100 >= -25)::INT) >= 5 AS passed FROM w2 JOIN regimes USING (trading_date)),
 w4 AS (SELECT *, {r('greatest(atr * 0.12, close * 0.0015)', 2)} AS buf, CASE WHEN base_pos >= 0.45 AND holding AND d50 >= -2 THEN 'HEALTHY_CONTRACTION' WHEN NOT holding OR d50 < -4 THEN 'DANGEROUS_CONTRACTION' ELSE 'NEUTRAL_CONTRACTION' END AS quality FROM w3),
 w5 AS (SELECT *, CASE WHEN squeeze <= 0.75 AND dry <= 0.75 AND quality = 'HEALTHY_CONTRACTION' THEN 'VCP_CONTRACTION_BREAKOUT' WHEN s50 IS NOT NULL AND d50 BETWEEN -2.5 AND 2.5 AND s50 > coalesce(s200, 0) THEN '50EMA_PULLBACK'
  WHEN dh >= -4 THEN '52W_HIGH_BREAKOUT' ELSE 'BASE_CONSOLIDATION' END AS setup FROM w4),
 w6 AS (SELECT *, CASE setup WHEN 'VCP_CONTRACTION_BREAKOUT' THEN high8 WHEN '50EMA_PULLBACK' THEN high3 WHEN '52W_HIGH_BREAKOUT' THEN hi2 ELSE high20 END AS raw,
  CASE setup WHEN 'VCP_CONTRACTION_BREAKOUT' THEN low8 WHEN '50EMA_PULLBACK' THEN low5 ELSE low20 END AS floor_ FROM w5),
 w7 AS (SELECT *, {r('raw + buf', 2)} AS first_pivot, list_max(list_transform(list_filter(recent, lambda b: b.h >= raw * 0.992 AND (b.h - b.c) / greatest(0.01, b.h - b.l) >= 0.35 AND (b.c - b.l) / greatest(0.01, b.h - b.l) < 0.5), lambda b: b.h)) AS trap FROM w6),
 w8 AS (SELECT *, CASE WHEN trap IS NOT NULL THEN greatest(first_pivot, {r('greatest(raw, trap) + buf', 2)}) ELSE first_pivot END AS pivot_ FROM w7),
 w9 AS (SELECT *, {r(f"least(pivot_ - {r('0.5 * atr', 2)}, greatest(floor_ - {r('0.05 * atr', 2)}, pivot_ - {r('2.0 * atr', 2)}))", 2)} AS stop, greatest(atr * 2, pivot_ - low30) AS depth, close < hi2 * 0.97 AS below FROM w8),
 w10 AS (SELECT *, {r('(pivot_ - stop) / pivot_ * 100', 2)} AS risk_pct, CASE WHEN below THEN least(hi2, {r('pivot_ + greatest(depth * 0.85, 1.8 * atr)', 2)}) ELSE {r('pivot_ + greatest(depth, 2 * atr)', 2)} END AS t1,
  CASE WHEN below THEN {r('pivot_ + greatest(depth * 1.5, 3.2 * atr)', 2)} ELSE {r('pivot_ + greatest(depth * 1.618, 4 * atr)', 2)} END AS t2, {r('(close - pivot_) / pivot_ * 100', 2)} AS distance FROM w9),
 w11 AS (SELECT *, {r('greatest(0.1, t1 - pivot_) / greatest(0.1, pivot_ - stop)', 2)} AS reward, CASE WHEN high3 >= least(first_pivot, pivot_) AND close < greatest(first_pivot, pivot_) * 0.985 THEN 'FAILED_SETUP'
  WHEN distance < -2.5 THEN 'CONSTRUCTING_BASE' WHEN distance <= 0 THEN 'TRIGGER_WATCH' WHEN distance <= 2.5 THEN 'ACTIONABLE_BUY' WHEN distance <= 5 THEN 'LATE_BUY_ZONE' ELSE 'EXTENDED' END AS status FROM w10),
 audited AS (SELECT *, {r(f'''{r("CASE WHEN quality = 'HEALTHY_CONTRACTION' THEN least(40, least(40, (1 - least(1, squeeze)) * 80) + 5) ELSE least(40, (1 - least(1, squeeze)) * 80) END + least(30, (1 - least(1, dry)) * 60) + CASE WHEN status IN ('TRIGGER_WATCH', 'ACTIONABLE_BUY') THEN 30 WHEN status = 'CONSTRUCTING_BASE' THEN 20 ELSE 10 END", 1)} * 0.35
  + least(100, 50 + CASE WHEN passed THEN 30 ELSE 0 END + CASE WHEN d50 > 0 THEN 10 ELSE 0 END + CASE WHEN dh >= -15 THEN 10 ELSE 0 END) * 0.30
  + {r(f"least(50, {r('coalesce(up_volume, 0) / greatest(1, coalesce(down_volume, 0))', 2)} / 2 * 50) + greatest(0, least(50, (1 - least(1.2, dry)) * 65) - least(20, dist_days * 5))", 1)} * 0.20
  + {r("least(100, greatest(15, reward / 2.5 * 75))", 1)} * 0.15''', 1)} AS readiness FROM w11)"""

CANDIDATES = f"""c0 AS (SELECT *, count(*) OVER (PARTITION BY company_id) AS total, [{', '.join(f"{{'h': lead(high, {i}) OVER ({W}), 'l': lead(low, {i}) OVER ({W}), 'o': lead(open, {i}) OVER ({W}), 'i': {i}}}" for i in (1, 2, 3))}] AS ahead FROM audited),
 c1 AS (SELECT *, list_filter(ahead, lambda b: b.h >= pivot_)[1] AS reached, list_filter(ahead, lambda b: b.l <= stop)[1] AS touched FROM c0),
 entries AS (SELECT company_id, trading_date AS t0, rn AS signal_n, CASE WHEN status = 'ACTIONABLE_BUY' THEN rn ELSE rn + reached.i END AS entry_n, CASE WHEN status = 'ACTIONABLE_BUY' THEN close ELSE greatest(pivot_, reached.o) END AS entry,
  stop, t1, t2, setup, quality, regime, readiness FROM c1 WHERE rn > 40 AND total >= 50 AND rn <= total - 5 AND risk_pct <= 8.5 AND risk_pct > 0 AND reward >= 1.7
  AND (status = 'ACTIONABLE_BUY' OR (status = 'TRIGGER_WATCH' AND reached IS NOT NULL AND (touched IS NULL OR reached.i < touched.i))))"""


def walk(optimistic: bool) -> str:
    o = "true" if optimistic else "false"
    return f"""nb AS (SELECT company_id, rn, open, high, low, close FROM w0),
 walk AS (SELECT e.*, 0 AS d, false AS done, false AS hit, e.stop AS trail, NULL::DOUBLE AS exit_, 'EXPIRED' AS outcome, false AS both_, NULL::INT AS days_t1, NULL::INT AS days_stop, 0.0::DOUBLE AS mfe, 0.0::DOUBLE AS mae, e.entry AS last_close FROM entries e
  UNION ALL SELECT s.company_id, s.t0, s.signal_n, s.entry_n, s.entry, s.stop, s.t1, s.t2, s.setup, s.quality, s.regime, s.readiness, d + 1, done OR stops OR wins, hit2, CASE WHEN takes THEN greatest(trail, {r('entry * 1.002', 2)}) ELSE trail END,
   CASE WHEN stops THEN least(trail, open) WHEN wins THEN t2 ELSE exit_ END, CASE WHEN stops THEN CASE WHEN hit THEN 'T1_HIT_TRAILED_OUT' ELSE 'STOPPED_OUT' END WHEN wins THEN 'T2_HIT' ELSE outcome END, both_ OR b2,
   CASE WHEN takes THEN d + 1 ELSE days_t1 END, CASE WHEN stops THEN d + 1 ELSE days_stop END, greatest(mfe, (high - entry) / entry * 100), least(mae, (low - entry) / entry * 100), close
  FROM (SELECT *, stops0 AND NOT (b2 AND {o}) AS stops, hit OR takes AS hit2, NOT (stops0 AND NOT (b2 AND {o})) AND (hit OR takes) AND high >= t2 AS wins FROM
   (SELECT *, first_ AND (NOT stops0 OR {o}) AS takes, stops0 AND first_ AS b2 FROM (SELECT k.*, nb.open, nb.high, nb.low, nb.close, nb.low <= trail AS stops0, nb.high >= t1 AND NOT hit AS first_
    FROM walk k JOIN nb ON nb.company_id = k.company_id AND nb.rn = k.entry_n + k.d + 1 WHERE NOT k.done AND k.d < 45))) s),
 ended AS (SELECT *, d AS days, entry_n + d AS exit_n, coalesce(exit_, last_close) AS exit, CASE WHEN done THEN outcome WHEN hit THEN 'T1_HIT_EXPIRED' ELSE 'EXPIRED' END AS result FROM walk WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY company_id, signal_n ORDER BY d DESC) = 1),
 labelled AS (SELECT *, (exit - entry) / entry * 100 AS pnl_pct, (exit - entry) / greatest(0.01, entry - stop) AS r FROM ended)"""


TAKE = """ordered AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY signal_n) AS k FROM labelled),
 pick AS (SELECT company_id, k, signal_n, true AS taken, exit_n AS last FROM ordered WHERE k = 1
  UNION ALL SELECT o.company_id, o.k, o.signal_n, o.signal_n > p.last + 5, CASE WHEN o.signal_n > p.last + 5 THEN o.exit_n ELSE p.last END FROM pick p JOIN ordered o ON o.company_id = p.company_id AND o.k = p.k + 1),
 trades AS (SELECT o.* FROM ordered o JOIN pick p USING (company_id, k) WHERE p.taken)"""

AUDIT = f"{CALM}, {TR}, {REGIME}, {IND}"
TRADES = f"{AUDIT}, {CANDIDATES}, {walk(False)}, {TAKE}"
