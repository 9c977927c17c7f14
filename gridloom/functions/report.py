"""Texts that report on models and readings. Wording and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.lengths import int_div, shown

CAPS = {"phone": 1400, "desktop": 2000}
#: Least palette confidence, least and most fabrics of a palette that can be trusted.
TRUST, LEAST_FABRICS, MOST_FABRICS = 0.8, 2, 6
REASONS = {
    "no_quilt_found": "We could not tell the quilt apart from the background.",
    "no_periodicity": "We did not find any repeating structure to read.",
    "profile_too_short": "The photo is too small to read squares from.",
    "anisotropic_pitch": "The rows and columns disagree - the photo may show the quilt at a steep angle.",
    "implausible_dims": "The grid we found is not a plausible quilt.",
    "weak_periodicity": "The square pattern is too faint to read confidently.",
    "non_square_content": "The blocks repeat, but the shapes inside are not squares - only square patchwork can be recovered, not curves or triangles yet.",
}
NO_REASON = "The pattern did not read as a grid of squares."
MODES = {"no_grid": "failure", "non_square_repeat": "nonsquare"}
PILLS = {"no_grid": "Could not read this photo", "non_square_repeat": "blocks repeat - squares uncertain"}
NO_REPEAT = "No repeating block found - common for samplers and medallion quilts."


def confidence_word(x: Column) -> Column:
    return F.when(x >= 0.95, "Very sure").when(x >= 0.85, "Solid").when(x >= 0.8, "Good").otherwise("Check it")


def overall_percent(stages: Column) -> Column:
    """The mean of an array of stage confidences as a percent, halves up; 0 without any."""
    mean = F.when(F.size(stages) > 0, F.aggregate(stages, F.lit(0.0), lambda a, x: a + x) / F.size(stages)).otherwise(0.0)
    return F.floor(mean * 100 + 0.5).cast("long")


def overall_word(percent: Column) -> Column:
    return F.when(percent >= 92, "very sure").when(percent >= 84, "solid").when(percent >= 78, "good - check the flags").otherwise("needs your eye")


def trusted_palette(confidence: Column, fabrics: Column) -> Column:
    return (confidence >= TRUST) & fabrics.between(LEAST_FABRICS, MOST_FABRICS)


def period_phrase(cells: Column, cols: Column, cell_size: Column, sized: Column) -> Column:
    """How often a block of `cells` cells repeats: as a length if the size is known, else across the width."""
    across = int_div(cols, F.greatest(cells, F.lit(1)))
    length = F.regexp_replace(shown(cells * cell_size), '"$', "")
    by_count = F.when(across >= 2, F.concat(F.lit("It repeats about "), across.cast("string"), F.lit(" times across its width.")))
    return F.when(cells >= 1, F.when(sized, F.concat(F.lit("It repeats every "), length, F.lit(" in."))).otherwise(by_count))


def story(verdict: Column, diagnosis: Column, phrase: Column) -> dict[str, Column]:
    """mode, pill, reason, caption and first_dashed (the first of the six stages that is drawn dashed, null for
    none) of a verdict; a null verdict counts as readable."""
    def by(table: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    v = F.coalesce(verdict, F.lit("readable"))
    failed = v == "no_grid"
    return {
        "mode": F.coalesce(by(MODES, v), F.lit("percent")), "pill": F.coalesce(by(PILLS, v), F.lit("")),
        "reason": F.when(failed, F.coalesce(by(REASONS, F.coalesce(diagnosis, F.lit(""))), F.lit(NO_REASON))),
        "caption": F.when(v == "readable_no_repeat", NO_REPEAT).when(v == "readable", phrase),
        "first_dashed": F.when(failed, F.when(diagnosis == "no_quilt_found", 0).otherwise(2)),
    }


def cm_shown(eighths: Column) -> Column:
    return F.format_string("%.1f", F.floor(eighths / F.lit(8.0) * 2.54 * 10 + 0.5) / 10)


def device_class(viewport: Column) -> Column:
    return F.when(viewport < 720, "phone").otherwise("desktop")


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def quarters_shown(quarters: Column) -> Column:
    whole, part = int_div(quarters, 4), F.element_at(F.array(F.lit(""), F.lit("1/4"), F.lit("1/2"), F.lit("3/4")), (quarters % 4 + 1).cast("int"))
    return F.when(quarters % 4 == 0, whole.cast("string")).when(whole == 0, part).otherwise(F.concat_ws(" ", whole.cast("string"), part))


def achieved_shown(requested_width: Column, requested_height: Column, width: Column, height: Column) -> Column:
    """What a resize came to, and what was asked for if that differs."""
    def size(w: Column, h: Column) -> Column:
        return F.concat(shown(w), F.lit(" x "), shown(h))

    differs = (requested_width != width) | (requested_height != height)
    return F.when(differs, F.concat(F.lit("Requested "), size(requested_width, requested_height), F.lit(" - achieved "), size(width, height))).otherwise(size(width, height))


def settings_json(rows: Column, cols: Column, cell_size: Column, borders: Column) -> Column:
    """Sizes as JSON; borders: an array of structs (fabric_id, width), inner band first."""
    center = F.struct(rows.alias("rows"), cols.alias("cols"), cell_size.alias("cell_size"))
    return F.to_json(F.struct(center.alias("center"), borders.alias("borders")), {"ignoreNullFields": "false"})
