"""Operations of a training-data pipeline over large text tables. Nothing else in the package imports this one."""
