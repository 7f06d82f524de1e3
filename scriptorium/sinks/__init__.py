"""Writers that turn document tables into packages and previews."""
