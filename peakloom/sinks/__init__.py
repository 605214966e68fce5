"""Writers of feature tables, spectra and reports."""
