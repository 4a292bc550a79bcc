from .kinds import (
    categorical_columns, columns_by_kind, columns_of_kind, datetime_columns, kind_of, numeric_columns, select_kind,
)
from .missing import as_double, is_missing, present
from .scalars import clip, datetime_sql, finite, number_sql, strip
