"""Columns of floating-point results, which are rounded alike in a query and its SQL twin (sums differ in last digits).

A name may say how many digits; times, which are single operations on both sides, are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def rounded(c: Column | str, digits: int) -> Column:
    """A double rounded as SQL twins do it: scaled, to the nearest whole number (half away from zero), scaled back.

    Spark's round goes by the shortest decimal text of a number instead and differs where that ends in a five.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scaled = c * 10.0**digits
    return F.when(F.abs(scaled) == float("inf"), c).otherwise(F.round(scaled) / 10.0**digits)


DOUBLES: dict[str, str] = {
    "recipe_results": "level scaled",
    "load_by_profile": "mass_g is_valid",
    "load_delimited": "preis:2 time_seconds",
    "derived_correlated": "at_20 u_at_20 zero u_zero ratio u_ratio",
    "step_statistics": "value",
    "window_measures": "value",
    "quality_settings": "jump window_s",
    "budget_bars": "u share",
    "derived_quantities": "ea u_ea k0 u_k0",
    "fixed_constants": "y:4 u_y:4",
    "looked_up": "found",
    "manual_steps": "start end",
    "measure_uncertainty": "u_mean",
    "monte_carlo_line": "m_mean:4 m_sd:4 b_mean:3 b_sd:3",
    "named_windows": "low high",
    "own_uncertainty": "rate u_rate part u_twice",
    "relations_in_order": "ref step_bin:3 total:4",
    "relinked_windows": "step_start",
    "steps_of_a_table": "start end",
    "window_overrides": "low high",
    "absolute_time": "s",
    "constant_range": "low high",
    "covered_seconds": "covered_s",
    "long_channels": "value",
    "robust_range": "low high",
    "secondary_axis": "x2",
    "source_span": "start end",
    "aggregate_max": "l_quantity_max",
    "aggregate_mean": "l_quantity_mean",
    "aggregate_median": "l_quantity_median",
    "aggregate_min": "l_quantity_min",
    "aggregate_std": "l_quantity_std",
    "aggregate_sum": "l_quantity_sum",
    "aligned_curve": "minutes",
    "asof_broadcast": "amount",
    "asof_last_error": "last_error",
    "bin_values": "binned",
    "budget_shares": "share",
    "channel_availability": "fill_ratio",
    "clock_pairs": "offset mad u",
    "clock_seconds": "seconds",
    "cross_correlation": "lag:4 r overlap",
    "cumulative_reset": "total",
    "end_rule_fallback": "step_end",
    "fill_ratio": "fill_ratio",
    "formula_gradient": "y by_quantity by_tax by_tax_of_log",
    "formula_piecewise": "value",
    "formula_values": "ratio logs pick bounds text even",
    "jump_candidates": "level",
    "jump_threshold": "threshold",
    "lag_correlation": "r",
    "level_crossing": "x_cross x_low x_high",
    "level_of_window": "last_value",
    "line_fit": "m:4 b:4 u_m:4 u_b:4 chi2_red birge",
    "line_fit_gls": "m b chi2_red:4",
    "line_fit_weighted": "m b",
    "lod_min_max": "low high",
    "matrix_cells": "mean low high",
    "measure_priority": "mean",
    "merge_newest": "o_totalprice",
    "midnight_rollover": "seconds",
    "minimal_trace": "time value",
    "moving_mean": "smooth",
    "monte_carlo_crossing": "share",
    "nearest_reference": "ref u_ref",
    "pivot_matrix": "F O",
    "pivot_wide_first": "click error purchase signup view",
    "resample_linear": "value",
    "resolution": "resolution",
    "row_covariance": "own:9 c_hours:9",
    "run_summary": "median_dt_s:9",
    "run_time": "run_time_s",
    "scenario_compare": "rate",
    "spike_window": "window_s:9",
    "step_expanded": "y",
    "step_intervals": "s0 s1 amount",
    "step_results": "duration_s mean ratio",
    "table_view": "o_totalprice",
    "timeline_page": "from to",
    "typed_numbers": "value",
    "typed_numbers_comma": "value",
    "uncertainty_budget": "rate u_rate u_rate_random u_rate_systematic share u_share scale_part",
    "unpivot_long": "value",
    "until_next_window": "until",
    "window_autocorr": "rho1 n_eff sem_eff",
    "window_durbin_watson": "durbin_watson",
    "window_counts": "window_s",
    "window_integral": "integral covered_s coverage integral_gap_s integral_u_e6:5",
    "window_location": "mean median sd sem min max q05 q95",
    "window_robust": "slope_se_hac_e6:3 slope_se_ar1_e6:3 slope_se_eff_e6:3 durbin_watson:5 slope_theil_sen_e6:4 intercept_theil_sen ts_ci_low_e6:4 ts_ci_high_e6:4 halves_diff",
    "window_rule": "low high",
    "window_slope": "slope_e6 slope_se_e6 intercept r2",
    "window_stationary": "halves_diff",
    "window_two_point": "two_point_e6:3 two_point_u_e6:3 two_point_dt two_point_offset_s",
    "window_two_point_median": "two_point_e6:3 two_point_u_e6:3",
    "xy_view": "x y",
}
