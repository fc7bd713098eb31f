"""Policy scoring: weighted signals over what is known, bands, confidence and reasons. Unknown signals neither help nor hurt."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Bases, weights, thresholds in metres, saturation counts, bands, confidence tiers and policy hours.
POLICY = {
    "category": {
        "OPEN_MANHOLE": 1.00, "TRAFFIC_SIGNAL_FAULT": 0.85, "WATER_LEAKAGE_WATERLOGGING": 0.75, "DRAINAGE_SEWER": 0.70, "FALLEN_TREE": 0.70,
        "POTHOLE": 0.55, "ROAD_DAMAGE": 0.50, "FOOTPATH_DAMAGE": 0.45, "PUBLIC_INFRASTRUCTURE_DAMAGE": 0.45, "STREETLIGHT_FAULT": 0.40,
        "CONSTRUCTION_OBSTRUCTION": 0.40, "SIGNAGE_DAMAGE": 0.30, "GARBAGE_DUMPING": 0.30, "GRAFFITI_VISUAL_POLLUTION": 0.10, "OTHER": 0.35,
    },
    "absolute": ["OPEN_MANHOLE"],
    "weights": {
        "category": 0.30, "near_school": 0.12, "near_hospital": 0.10, "near_metro": 0.08, "near_public_transport": 0.05, "near_major_road": 0.09,
        "near_intersection": 0.07, "near_fire_station": 0.02, "near_police_station": 0.02, "near_government_building": 0.02, "metro_city": 0.04,
        "urban_area": 0.03, "local_incident_density": 0.03, "nearby_similar_incidents_30d": 0.03,
    },
    "within_m": {
        "near_school": 200, "near_hospital": 300, "near_metro": 300, "near_public_transport": 200, "near_major_road": 100, "near_intersection": 50,
        "near_fire_station": 500, "near_police_station": 500, "near_government_building": 300,
    },
    "distance": {
        "near_school": "distance_to_nearest_school_m", "near_hospital": "distance_to_nearest_hospital_m", "near_metro": "distance_to_nearest_metro_m",
        "near_public_transport": "distance_to_nearest_public_transport_m", "near_major_road": "distance_to_major_road_m",
        "near_intersection": "distance_to_nearest_intersection_m", "near_fire_station": "distance_to_nearest_fire_station_m",
        "near_police_station": "distance_to_nearest_police_station_m", "near_government_building": "distance_to_nearest_government_building_m",
    },
    "saturation": {"local_incident_density": 50, "nearby_similar_incidents_30d": 30},
    "labels": {
        "near_school": "near a school", "near_hospital": "near a hospital", "near_metro": "near a metro station", "near_public_transport": "near public transport",
        "near_major_road": "on or beside a major road", "near_intersection": "near an intersection", "near_fire_station": "near a fire station",
        "near_police_station": "near a police station", "near_government_building": "near a government building", "metro_city": "in a metropolitan city",
        "urban_area": "in an urban area", "local_incident_density": "high local incident density",
        "nearby_similar_incidents_30d": "many similar incidents reported nearby recently",
    },
    "bands": [(0.75, "P1"), (0.55, "P2"), (0.30, "P3")], "tiers": [(8, 0.70, "HIGH"), (3, 0.30, "MEDIUM")],
    "hours": {"P1": 30, "P2": 50, "P3": 72, "P4": 90}, "reasons": 5, "least": 0.03,
}


def _text(x: str) -> str:
    return "'" + x.replace("'", "\\'") + "'"


def signals(columns: list[str], policy: dict = POLICY) -> dict[str, str]:
    """SQL of the signals by weight's name, before they are held to [0, 1]: the category's base, 1 - distance / threshold, flags, counts / saturation.

    An input that is NULL, or no column at all, gives NULL; a category without a base of its own counts as OTHER."""
    bases = " ".join(f"WHEN {_text(c)} THEN {float(v)!r}D" for c, v in policy["category"].items())
    out = {}
    for name in policy["weights"]:
        source = policy["distance"].get(name, name)
        if source not in columns:
            out[name] = "cast(NULL AS double)"
        elif name == "category":
            out[name] = f"CASE WHEN length(category) > 0 THEN CASE category {bases} ELSE {float(policy['category']['OTHER'])!r}D END END"
        elif name in policy["within_m"]:
            out[name] = f"1 - `{source}` / {float(policy['within_m'][name])!r}D"
        elif name in policy["saturation"]:
            out[name] = f"`{source}` / {float(policy['saturation'][name])!r}D"
        else:
            out[name] = f"cast(cast(`{source}` AS boolean) AS double)"
    return out


def score(df: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Adds score, coverage, n_signals, band, confidence, reasons and policy hours; bands are taken before rounding.

    Signals are one array, which few expressions go over: fourteen times the same expressions make generated code that is too long to
    be compiled to machine code."""
    w = {n: f"{float(v)!r}D" for n, v in policy["weights"].items()}
    total = float(sum(policy["weights"].values()))
    raw = ", ".join(signals(df.columns, policy).values())
    df = df.selectExpr("*", f"transform(array({raw}), v -> IF(v IS NULL, NULL, least(1D, greatest(0D, v)))) AS _s")
    weights = f"array({', '.join(w.values())})"
    fixed = "coalesce(category IN (" + ", ".join(_text(c) for c in policy["absolute"]) + "), false)"
    added = lambda x: f"aggregate(zip_with(_s, {weights}, (s, w) -> {x}), 0D, (a, x) -> a + x)"
    df = df.selectExpr("*", f"{added('coalesce(s * w, 0D)')} AS _top", f"{added('IF(s IS NULL, 0D, w)')} AS _w", "size(filter(_s, s -> s IS NOT NULL)) AS _n", f"{fixed} AS _fixed")
    # Sums of weights are compared with the tiers free of the error of their last digits.
    df = df.selectExpr(
        "*", "CASE WHEN _fixed THEN 1D WHEN _w > 0 THEN _top / _w END AS _score", f"CASE WHEN _fixed THEN 1D ELSE round(_w / {total!r}D, 10) END AS _coverage", "IF(_fixed, 1, _n) AS n_signals",
    )
    band = " ".join(f"WHEN round(_score, 12) >= {float(least)!r}D THEN '{name}'" for least, name in policy["bands"])
    tier = " ".join(f"WHEN n_signals >= {n} AND _coverage >= {float(c)!r}D THEN '{name}'" for n, c, name in policy["tiers"])
    df = df.selectExpr("*", f"CASE WHEN _score IS NOT NULL THEN CASE {band} ELSE 'P4' END END AS band", f"CASE WHEN _fixed THEN 'HIGH' {tier} ELSE 'LOW' END AS confidence")
    label = {n: "concat('category ', coalesce(category, '?'))" if n == "category" else _text(policy["labels"][n]) for n in w}
    parts = f"zip_with(transform(_s, (s, i) -> named_struct('v', -round(s * {weights}[i], 6), 'i', i)), array({', '.join(label.values())}), (x, n) -> named_struct('v', x.v, 'i', x.i, 'n', n))"
    best = f"slice(array_sort(filter({parts}, x -> x.v <= {-float(policy['least'])!r}D)), 1, {policy['reasons']})"
    pieces = f"transform({best}, x -> concat(x.n, ' (', format_string('%.2f', bround(-x.v, 2)), ')'))"
    note = f"IF(confidence <> 'HIGH', concat(confidence, ' CONFIDENCE: only ', cast(n_signals AS string), ' of {len(w)} inputs available'), NULL)"
    text = f"""CASE WHEN _fixed THEN concat('category rule: incident category ', category, ' is an unconditional immediate hazard')
     WHEN _w > 0 THEN concat_ws(' | ', {pieces}, {note}) ELSE 'no scoring inputs available' END"""
    hours = "CASE band " + " ".join(f"WHEN '{b}' THEN {h}" for b, h in policy["hours"].items()) + " END"
    keep = [f"`{c}`" for c in df.columns if c not in ("_s", "_top", "_w", "_n", "_fixed", "_score", "_coverage")] + [f"_s[{i}] AS s_{n}" for i, n in enumerate(w)]
    return df.selectExpr(*keep, f"{text} AS reasons", f"{hours} AS policy_hours", "bround(round(_score, 10), 4) AS score", "bround(_coverage, 4) AS coverage", "false AS is_ground_truth")
