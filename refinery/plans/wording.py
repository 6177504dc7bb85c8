"""What actions are called and what they do, in words; a stage may have its own."""

from __future__ import annotations

#: Names of actions. Each has a label and a line that describes it.
TEXT = {
    "continue": ("Go on", "Nothing to decide here."),
    "drop_variable": ("Drop the column", "The column leaves the table."),
    "drop_rows": ("Drop the rows", "Rows with this finding leave the table."),
    "leave_as_is": ("Leave as it is", "The cells stay as they were read."),
    "inspect": ("Look at it by hand", "Nothing changes now; the finding is kept in the log."),
    "median_impute": ("Fill with the median", "Empty cells take the middle value of the column."),
    "mean_impute": ("Fill with the mean", "Empty cells take the mean of the column."),
    "mode_impute": ("Fill with the most frequent value", "Empty cells take the value that comes most often."),
    "regression_impute": ("Fill by chained regressions", "Empty cells are predicted from the other numeric columns, in rounds."),
    "flag_missing_indicator": ("Add a column that marks missing cells", "A new column says where cells were empty; they stay empty."),
    "treat_as_missing": ("Set flagged values to missing", "Flagged values become empty cells."),
    "winsorize": ("Limit values to the fences", "Values beyond a fence move to the fence."),
    "remove_all_duplicates": ("Keep the first of equal rows", "Of rows that agree in all key columns the first stays."),
    "keep_all_duplicates": ("Keep all rows", "Equal rows stay."),
    "drop_all_duplicate_rows": ("Drop every copy", "Rows that have a copy leave, the first one too."),
    "merge_keep_first": ("Keep the first row of the key", "Of the rows with this key the first stays."),
    "merge_keep_last": ("Keep the last row of the key", "Of the rows with this key the last stays."),
    "keep_all": ("Keep all rows of the key", "Rows that share a key stay."),
    "keep_rows": ("Keep rows without a file", "Rows stay whether they have a file or not."),
    "add_indicator": ("Mark rows without a file", "A new column says which rows have a file."),
    "flag_caveat": ("Note it in the report", "Nothing changes; the report says so."),
    "exclude_path": ("Leave the file path out", "The path of the file is no column of the result."),
    "include_path": ("Add the file path", "A new column holds the path of each row's file."),
    "quantile_bin": ("Bins of equal counts", "Edges are quantiles, so that bins hold about as many rows each."),
    "equal_width_bin": ("Bins of equal width", "The range is cut into pieces of one width."),
    "natural_breaks_bin": ("Bins at natural breaks", "Edges lie where values are far apart."),
    "skip": ("Do nothing", "This step is left out."),
    "standard_scale": ("Scale to mean 0 and deviation 1", "The mean goes, then the standard deviation divides."),
    "minmax_scale": ("Scale to 0 to 1", "The least value becomes 0, the greatest 1."),
    "robust_scale": ("Scale by median and quartiles", "The median goes, then the distance of the quartiles divides."),
    "log_scale": ("Logarithm of 1 + x", "Large values move together; negative ones count as 0."),
    "frequency_encode": ("Replace by relative frequency", "A new column holds the share of rows with this label."),
    "datetime_decompose": ("Split into calendar parts", "New columns hold year, month, day and so on."),
    "renamed": ("Renamed", "Columns took names in one style."),
    "stripped": ("White space taken off", "Blanks at the ends of cells went."),
    "converted": ("Tokens made missing", "Cells that stand for missing became empty."),
    "coerced": ("Stored as what it is", "Text became numbers, dates or truth values."),
    "normalized": ("Spellings joined", "Labels that differ in case took the most frequent spelling."),
}
#: What a stage says differently.
OF_STAGE = {
    ("duplicate", "inspect"): ("Decide later", "Rows that share the key stay until someone has looked at them."),
    ("outlier", "leave_as_is"): ("Keep the values", "Flagged values are taken as real."),
    ("outlier", "drop_rows"): ("Drop rows with flagged values", "Rows whose value lies beyond the fences leave the table."),
    ("missingness", "drop_rows"): ("Drop rows with empty cells", "Rows in which this column is empty leave the table."),
    ("missingness", "leave_as_is"): ("Leave cells empty", "Empty cells stay empty."),
    ("companion", "drop_rows"): ("Drop rows without a file", "Only rows that have a file stay."),
    ("binning", "skip"): ("Keep the numbers only", "No binned column is added."),
    ("scaling", "skip"): ("Keep the scale", "No scaled column is added."),
    ("encoding", "skip"): ("Keep the labels only", "No encoded column is added."),
}


def _text(action: str, stage: str | None) -> tuple[str, str]:
    plain = action.replace("_", " ").capitalize()
    return OF_STAGE.get((str(stage), action)) or TEXT.get(action) or (plain, plain + ".")


def label(action: str, stage: str | None = None) -> str:
    """The short name of an action; an unknown one is made readable."""
    return _text(action, stage)[0]


def description(action: str, stage: str | None = None) -> str:
    return _text(action, stage)[1]


def options(actions: list[str], recommended: str, stage: str | None = None) -> list[dict]:
    """What a person may choose from, in order, each action once."""
    return [{"action": a, "label": label(a, stage), "description": description(a, stage), "recommended": a == recommended} for a in dict.fromkeys(actions)]
