"""Forecasting on price-bar series with Spark."""

from seqcast.functions.columns import target_column
from seqcast.operators.prep import (
    cast_bars,
    drop_last_bars,
    missing_symbols,
    preview,
    select_symbols,
    union_bars,
)
from seqcast.operators.scale import (
    inverse_scale,
    inverse_scale_all,
    minmax_scale,
    minmax_scale_global,
    training_ranges,
)
from seqcast.operators.series import chronological_split, index_bars
from seqcast.operators.stats import (
    best_epoch,
    feature_ranges,
    mean_loss,
    minibatch_size,
    series_length,
    symbol_counts,
    symbol_total,
    value_bounds,
    weighted_param_average,
    window_counts,
)
from seqcast.operators.windows import assign_batches, both_blocks, make_windows, unfold_windows, window_blocks
from seqcast.schema import FEATURES, Category, SequenceConfig
from seqcast.session import build_session
from seqcast.sources.lineitem import bars_from_lineitem
from seqcast.sources.readers import read_bars_csv, read_symbol_files, read_symbol_folders, read_symbols, symbol_files
from seqcast.sources.writers import (
    load_model,
    predictions_as_documents,
    save_model,
    with_run_label,
    write_predictions,
    write_symbol_files,
)
from seqcast.training.averaging import AveragedModel, fit_averaged
from seqcast.training.forecaster import fit_forecaster
from seqcast.training.kernels import LinearKernel, LstmKernel
from seqcast.training.maps import fit_least_squares, fit_linear_averaged
from seqcast.training.predict import persistence_forecast, predict_all, predict_one_ahead, prediction_series
