"""Entities, grids, aliases, ranges and layouts that results depend on.

They are data, not logic; every plan takes them as arguments and uses these as
defaults.
"""

RIVER_GRID = {
    "Nyengwe": "grid_m4.25_29.50",
    "Buzimba": "grid_m4.00_29.50",
    "Jiji": "grid_m4.00_29.75",
    "Mulembwe": "grid_m4.00_29.50",
    "Mutimbuzi": "grid_m3.25_29.25",
    "Rusizi": "grid_m3.25_29.25",
    "Mpanda": "grid_m3.00_29.50",
    "Kaburantwa": "grid_m3.00_29.25",
    "Nyamagana": "grid_m3.00_29.25",
    "Nyakagunda": "grid_m2.75_29.00",
}

STATION_GRID = {
    "bujumbura aeroport": "grid_m3.25_29.25",
    "imbo sems": "grid_m3.25_29.25",
    "mparambo": "grid_m2.75_29.00",
    "mpota tora": "grid_m3.75_29.50",
    "nyanza lac irat": "grid_m4.25_29.50",
    "rwegura": "grid_m3.00_29.50",
}

# Order matters: without an exact hit the first alias found inside a name wins.
RIVER_ALIASES = (
    ("buzimba", "Buzimba"),
    ("buzimba gatete", "Buzimba"),
    ("jiji", "Jiji"),
    ("jiji ndago", "Jiji"),
    ("kaburantwa", "Kaburantwa"),
    ("kaburantwa mission", "Kaburantwa"),
    ("mpanda", "Mpanda"),
    ("mpanda gatura", "Mpanda"),
    ("mulembwe", "Mulembwe"),
    ("mulembwe mutambara", "Mulembwe"),
    ("basse mulembwe", "Mulembwe"),
    ("basse mulembwe mutambara", "Mulembwe"),
    ("murembwe", "Mulembwe"),
    ("mutimbuzi", "Mutimbuzi"),
    ("mutimbuzi pont aeroport", "Mutimbuzi"),
    ("nyakagunda", "Nyakagunda"),
    ("nyakagunda musenyi", "Nyakagunda"),
    ("nyamagana", "Nyamagana"),
    ("nyamagana murambi", "Nyamagana"),
    ("nyengwe", "Nyengwe"),
    ("nyengwe rimbo", "Nyengwe"),
    ("rusizi", "Rusizi"),
    ("rusizi gatumba", "Rusizi"),
)

# Column order of the published panel.
PANEL_COLUMNS = (
    "river",
    "date",
    "year",
    "month",
    "water_level",
    "runoff",
    "temp_max_observed",
    "temp_min_observed",
    "precip_observed",
    "temp_source",
    "precip_source",
    "era5_grid",
    "era5_t2m_mean",
    "era5_t2m_min",
    "era5_t2m_max",
    "era5_tp_sum",
    "era5_u10_mean",
    "era5_v10_mean",
    "era5_d2m_mean",
    "era5_msl_mean",
)

# Panel roll-up of hourly readings: output -> (input, aggregate); units afterwards.
HOURLY_TO_PANEL = {
    "era5_t2m_mean": ("t2m", "mean"),
    "era5_t2m_min": ("t2m", "min"),
    "era5_t2m_max": ("t2m", "max"),
    "era5_u10_mean": ("u10", "mean"),
    "era5_v10_mean": ("v10", "mean"),
    "era5_d2m_mean": ("d2m", "mean"),
    "era5_msl_mean": ("msl", "mean"),
    "era5_tp_sum": ("tp", "sum"),
}
KELVIN_TO_CELSIUS = (1.0, -273.15)
METRES_TO_MILLIMETRES = (1000.0, 0.0)
PASCAL_TO_HECTOPASCAL = (0.01, 0.0)
PANEL_UNITS = {
    "era5_t2m_mean": KELVIN_TO_CELSIUS,
    "era5_t2m_min": KELVIN_TO_CELSIUS,
    "era5_t2m_max": KELVIN_TO_CELSIUS,
    "era5_d2m_mean": KELVIN_TO_CELSIUS,
    "era5_tp_sum": METRES_TO_MILLIMETRES,
}

# Monthly export of hourly readings: units first, every month, sums 0 when empty.
HOURLY_TO_EXPORT = {
    "t2m_mean_C": ("t2m", "mean"),
    "d2m_mean_C": ("d2m", "mean"),
    "tp_sum_mm": ("tp", "sum"),
    "msl_mean_hPa": ("msl", "mean"),
    "u10_mean": ("u10", "mean"),
    "v10_mean": ("v10", "mean"),
}
EXPORT_UNITS = {
    "t2m": KELVIN_TO_CELSIUS,
    "d2m": KELVIN_TO_CELSIUS,
    "tp": METRES_TO_MILLIMETRES,
    "msl": PASCAL_TO_HECTOPASCAL,
}
